"""A persisted vector index: cells around centres, each with a radius, and exact search that reads only the cells it must.

Angles between vectors obey the triangle inequality, so no vector of a cell is nearer to a query than the
query's angle to the cell's centre less the cell's radius. A search first reads the cells of the least bounds that
hold ``k`` vectors, then those that can still hold one nearer than the k-th found; other cells are pruned as partitions
of the table. The result is that of comparing all vectors.

The manifest has one row a cell (at most ``MOST_CELLS``) and is what the driver holds of an index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.tables import checkpointed
from .retrieval import POINT_STEP, QUERY_BLOCK, QUERY_STEP, Best, _matrix, _units, ranked

#: Cells of an index at most.
MOST_CELLS = 4096
#: Vectors that the centres are fitted on at most; every vector is indexed.
FIT_ROWS = 20_000
#: Rounding that angles and scores may be off by.
_SLACK = 2e-6


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; the first centres are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)] if len(sample) else np.zeros((0, 0))
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], sums, centres)
        centres = _units(centres)
    return centres


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            x = _units(_matrix(batch.column(1), centres.shape[1]))
            angle = _angles(x, centres)
            cell = angle.argmin(axis=1)
            zero = ~x.any(axis=1)  # no direction: a cell that no bound refuses
            near = np.where(zero, np.pi, angle[np.arange(len(x)), cell])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(zero, -1, cell).astype(np.int32)), pa.array(near)], ["point_id", "vector", "cell", "angle"])

    return run


def build_index(corpus: DataFrame, path: str, cells: int | None = None, fit_rows: int = FIT_ROWS) -> dict:
    """Write ``corpus(point_id, vector)`` by cell below ``path``, and a manifest; returns the manifest's totals.

    The width is that of the most vectors; vectors that are null, of another width or hold nulls are left out.
    Centres are fitted on at most ``fit_rows`` vectors in hashed order of their ids.
    """
    spark = corpus.sparkSession
    ship(spark)
    rows = corpus.select(F.col("point_id").cast("long").alias("point_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null and not exists(vector, x -> x is null)")
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width, n = (widths["width"], widths["n"]) if widths else (0, 0)
    rows = rows.where(F.size("vector") == width)
    cells = min(MOST_CELLS, cells or max(1, round(float(n) ** 0.5)))
    sample = rows.orderBy(F.xxhash64("point_id"), "point_id").limit(fit_rows).select("vector").toArrow()["vector"].combine_chunks()
    x = _units(_matrix(sample, width))
    centres = fit_centres(x[x.any(axis=1)], min(cells, max(1, int(x.any(axis=1).sum())))) if n else np.zeros((1, width))
    placed = rows.mapInArrow(_assigned(spark.sparkContext.broadcast(centres)), "point_id long, vector array<double>, cell int, angle double")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    stored = spark.read.schema("point_id long, vector array<double>, angle double, cell int").parquet(f"{path}/cells") if n else placed
    per = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    where = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(-1, [0.0] * width)], "cell int, centre array<double>")
    per.join(where, "cell").coalesce(1).write.parquet(f"{path}/manifest")
    made = spark.read.parquet(f"{path}/manifest").agg(F.count("*").alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    totals = {"rows": made["rows"], "cells": made["cells"], "width": width}
    spark.createDataFrame([(json.dumps(totals),)], "value string").coalesce(1).write.text(f"{path}/entry")
    return totals


@dataclass
class Visits:
    """What a search read: cells a query on average of how many there are, and vectors compared."""

    queries: int = 0
    cells: int = 0
    read: int = 0
    compared: int = 0
    rows: int = 0
    _touched: set = field(default_factory=set)


class Index:
    """An index below a path that any session can open."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.totals = json.loads(spark.read.text(f"{path}/entry").first()["value"])
        rows = spark.read.parquet(f"{path}/manifest").orderBy("cell").collect()  # at most MOST_CELLS + 1
        width = self.totals["width"]
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.radius = np.array([r["radius"] for r in rows])
        self.centre = np.array([r["centre"] for r in rows]).reshape(len(rows), width)

    def _cells(self, wanted: np.ndarray) -> DataFrame:
        rows = self.spark.read.schema("point_id long, vector array<double>, cell int").parquet(f"{self.path}/cells")
        return rows.where(F.col("cell").isin(*self.cell[wanted].tolist()))

    def _probe(self, ids: np.ndarray, x: np.ndarray, visits: np.ndarray, k: int, digits: int, self_match: bool) -> DataFrame:
        """(query_id, point_id, score): the best of each task in the cells that ``visits`` (queries x cells) names."""
        wanted = np.flatnonzero(visits.any(axis=0))
        bits = np.packbits(visits[:, wanted].T, axis=1)  # a bit for each query and cell
        shared = self.spark.sparkContext.broadcast((ids, x, {int(c): i for i, c in enumerate(self.cell[wanted])}, bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, at, bits = shared.value
            best = Best(len(ids), k, digits)
            for whole in batches:
                for low in range(0, len(whole), POINT_STEP):
                    batch = whole.slice(low, POINT_STEP)
                    point, cell = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                    y = _units(_matrix(batch.column(1), x.shape[1]))
                    for c in np.unique(cell):
                        here, who = np.flatnonzero(cell == c), np.flatnonzero(np.unpackbits(bits[at[int(c)]], count=len(ids)))
                        for first in range(0, len(who), QUERY_STEP):
                            part = who[first : first + QUERY_STEP]
                            sims = x[part] @ y[here].T
                            if not self_match:
                                sims[ids[part][:, None] == point[here][None, :]] = -np.inf
                            best.add(part, point[here], sims)
            yield from best.batches(ids)

        return self._cells(visits.any(axis=0)).select("point_id", "vector", "cell").mapInArrow(run, "query_id long, point_id long, score double")

    def search(self, queries: DataFrame, k: int, digits: int = 6, self_match: bool = False, visits: Visits | None = None) -> DataFrame:
        """(query_id, point_id, score, rank) of the k nearest by cosine, as ``dense_topk`` gives them.

        ``queries(query_id, vector)`` are taken in blocks; queries without a vector of the index's width have no hits.
        """
        good = queries.where(F.col("vector").isNotNull() & (F.size("vector") == self.totals["width"]) & ~F.exists("vector", lambda v: v.isNull()))
        blocks = max(1, -(-good.count() // QUERY_BLOCK))
        found = None
        for i in range(blocks):
            part = good if blocks == 1 else good.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            rows = part.select(F.col("query_id").cast("long").alias("query_id"), "vector").orderBy("query_id").collect()  # about QUERY_BLOCK rows
            if rows and len(self.cell):
                hits = self._search_block(rows, k, digits, self_match, visits)
                found = hits if found is None else found.unionAll(hits)
        if found is None:
            found = self.spark.createDataFrame([], "query_id long, point_id long, score double")
        return ranked(found, k)

    def _search_block(self, rows: list, k: int, digits: int, self_match: bool, visits: Visits | None) -> DataFrame:
        ids = np.array([r["query_id"] for r in rows], np.int64)
        x = _units(np.array([r["vector"] for r in rows], float))
        bound = np.maximum(_angles(x, self.centre) - self.radius[None, :], 0.0)
        bound[:, self.cell == -1] = 0.0
        order = np.argsort(bound, axis=1, kind="stable")
        enough = np.cumsum(self.n[order], axis=1) - self.n[order] < k + (not self_match)  # cells until k others are there
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, enough, axis=1)
        near = checkpointed(self._probe(ids, x, first, k, digits, self_match), "near")
        worst = {r["query_id"]: r["s"] for r in ranked(near, k).groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        limit = np.array([np.arccos(np.clip(worst[i] - _SLACK, -1, 1)) if i in worst else np.inf for i in ids.tolist()])
        again = (bound <= limit[:, None] + _SLACK) & ~first
        if visits is not None:
            both = first | again
            visits.queries += len(ids)
            visits.cells, visits.rows = len(self.cell), int(self.n.sum())
            visits.read += int(both.sum())
            visits.compared += int((both * self.n[None, :]).sum())
            visits._touched |= set(np.flatnonzero(both.any(axis=0)).tolist())
        return near.unionAll(self._probe(ids, x, again, k, digits, self_match)) if again.any() else near
