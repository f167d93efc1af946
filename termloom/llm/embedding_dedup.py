"""Operator 10: embedding near-dedup by NN-descent.

Equal vectors are one class with a number of its own. The neighbour graph starts
from windows in the order of random-hyperplane signatures (range-sorted, so no
bucket can be hot) and is refined by joining neighbours of neighbours: the vectors
around a vector are compared with each other for a few rounds, those pairs of
which at least one is new there since the last round. Neighbours below ``floor``
lead nowhere and are not kept. A list is saturated when it holds k neighbours that
are near the threshold or above: only then may a link have been cut from it.
Vectors with saturated lists are compared exactly with all vectors outside their
component, and components that a link joins are merged. In the end links are
counted exactly within each component, so a list's length never limits a count.

Both exact steps work on blocks of vectors with a centre and a radius: by the
triangle inequality of angles, most pairs of blocks link wholly or not at all, and
only the others are compared vector by vector. A large group of near copies thus
costs its blocks, not its pairs.

A fixed number of vectors, half of them such as have links, are compared with all
others to audit the recall of each. As links are counted within components, a link
is found if its ends are in one component. If the recall is low for one vector, the
search is done again with longer lists, and after the last attempt all vectors are
compared in blocks.

Similarities of candidates are computed on 8-bit vectors, those of edges in
double precision.

Defined results: null, zero and non-finite vectors link with nothing and are
their own component; shorter vectors are compared as if padded with zeros;
rows with one vec_id and different vectors are different vectors; rows with equal
vectors link with each other; a null vec_id stays null: it names a component only
if nothing in it has an id (then its rows are kept); extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

#: Vectors of a component in one block; a task compares two blocks.
BLOCK = 1024
AUDIT = 256
#: Neighbours in sorted order that are compared with each other.
WINDOW = 128
#: Slack of angles, for rounding: pairs of blocks that are nearer to the threshold are compared.
SLACK = 1e-6


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double, usable) of lists that may be null or hold nulls."""
    width = max([len(r) for r in rows if r is not None], default=0)
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r is not None and len(r):
            x[i, : len(r)] = np.asarray([np.nan if v is None else v for v in r] if any(v is None for v in r) else r, np.float64)
    ok = np.isfinite(x).all(axis=1) & (np.abs(np.nan_to_num(x)).max(axis=1, initial=0) > 0)
    x[~ok] = 0
    top = np.abs(x).max(axis=1, initial=0, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1), ok


def _planes(n: int, width: int, seed: int) -> np.ndarray:
    """Random hyperplanes; the first columns are the same for every width."""
    parts = [np.random.default_rng([seed, i]).standard_normal((n, 1024)) for i in range(-(-width // 1024))]
    return np.concatenate(parts, axis=1)[:, :width] if parts else np.zeros((n, 0))


def _prepared(trees: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _unit(batch.column(1).to_pylist())
            ids = batch.column(0).filter(pa.array(ok))
            x = x[ok]
            if not len(x):
                continue
            planes = _planes(trees * 63, x.shape[1], seed)
            bits = (x @ planes.T > 0).reshape(len(x), trees, 63)
            signs = (bits * (1 << np.arange(62, -1, -1, dtype=np.int64))).sum(axis=2)
            small = np.rint(x * 127 / np.abs(x).max(axis=1, keepdims=True)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([ids, pa.array([v.astype("<f8").tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in small], pa.binary()), pa.array(list(signs), pa.list_(pa.int64()))], ["id", "vec", "small", "signs"])

    return run


def _cosines(small: list[bytes]) -> np.ndarray:
    width = max(map(len, small))
    x = np.zeros((len(small), width), np.float32)
    for i, b in enumerate(small):
        x[i, : len(b)] = np.frombuffer(b, np.int8)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x @ x.T


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best partners of each row of a block: (from, to, similarity)."""
    n = len(ids)
    np.fill_diagonal(sims, -2)
    k = min(k, n - 1)
    if k < 1:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.float32)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    return ids[rows], ids[best.ravel()], sims[rows, best.ravel()]


_EDGES = "a long, b long, sim float"


def _edges(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["a", "b", "sim"])


def _windows(k: int, width: int = WINDOW):
    """Best partners among the neighbours in sorted order; windows overlap by half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, small = np.zeros(0, np.int64), []
        for batch in batches:
            ids = np.concatenate([ids, np.asarray(batch.column(0))])
            small += batch.column(1).to_pylist()
            while len(ids) >= 2 * width:
                yield _edges(*_top(ids[:width], _cosines(small[:width]), k))
                ids, small = ids[width // 2 :], small[width // 2 :]
        while len(ids) > 1:
            yield _edges(*_top(ids[:width], _cosines(small[:width]), k))
            if len(ids) <= width:
                break
            ids, small = ids[width // 2 :], small[width // 2 :]

    return run


def _local_join(k: int, floor: float, most: int = 256):
    """Compare the vectors around one vector with each other, in slices of bounded size; pairs that met here before are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, small, old, whole = pdf["b"].to_numpy(), pdf["small"].tolist(), ~pdf["new"].to_numpy(), bool((pdf["slices"] == 1).all())
        out = []
        for first in range(0, len(ids), most):
            part = slice(first, first + most)
            if len(ids[part]) > 1:
                sims = _cosines(small[part])
                if whole and len(ids) <= most:
                    sims[np.ix_(old, old)] = -2
                a, b, s = _top(ids[part], sims, k)
                keep = s >= floor
                out.append((a[keep], b[keep], s[keep]))
        if not out:
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "sim": pd.Series([], dtype="float32")})
        a, b, s = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": b, "sim": s.astype(np.float32)})

    return run


def _best(edges: DataFrame, k: Column) -> DataFrame:
    """The k best partners of each vector, of ``edges(a, b, sim, new, ...)``."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= k).select("a", "b", "sim", "new")


def neighbour_graph(vectors: DataFrame, k: int = 10, trees: int = 6, rounds: int = 2, near: float = 0.88, floor: float = 0.5) -> DataFrame:
    """(a, b, sim): near neighbours of ``vectors(id, small, signs)`` by NN-descent on 8-bit vectors."""
    # Windows end at the borders of ranges, so there are few ranges where there are few vectors.
    parts = max(1, min(c.shuffle_partitions(vectors.sparkSession), vectors.count() // (32 * WINDOW)))
    edges = None
    for t in range(trees):
        order = vectors.select("id", "small", F.col("signs")[t].alias("sign")).repartitionByRange(parts, "sign", "id").sortWithinPartitions("sign", "id")
        found = order.select("id", "small").mapInArrow(_windows(k), _EDGES)
        edges = found if edges is None else edges.unionAll(found)
    edges = edges.where(F.col("sim") >= floor).groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("new", F.lit(True))
    graph = c.materialize(_best(edges, F.lit(k)), "graph-0")
    for i in range(1, rounds + 1):
        # A saturated list (all reach the threshold) hides neighbours: it is enlarged in this round.
        full = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("worst")).where((F.col("n") >= k) & (F.col("worst") >= near)).select("a")
        around = graph.select("a", "b", "new").unionAll(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "new")).groupBy("a", "b").agg(F.max("new").alias("new"))
        # Popular vectors have many around them: slices of about 128 keep groups bounded, dealt anew each round.
        many = around.groupBy("a").agg(F.ceil(F.count("*") / 128).alias("slices"), F.max("new").alias("any"), F.count("*").alias("n")).where("any and n > 1").select("a", "slices")
        around = around.join(many, "a").join(vectors.select(F.col("id").alias("b"), "small"), "b").withColumn("slice", F.pmod(F.xxhash64("b", F.lit(i)), F.col("slices")))
        found = around.groupBy("a", "slice").applyInPandas(_local_join(k, floor), _EDGES)
        every = graph.select("a", "b", "sim", F.lit(False).alias("new")).unionAll(found.withColumn("new", F.lit(True))).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        wide = every.join(full.withColumn("wide", F.lit(2 * k)), "a", "left")
        better = c.materialize(_best(wide, F.coalesce("wide", F.lit(k))), f"graph-{i}")
        c.discard(graph)
        graph = better
    return graph


def _exact_edges(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(i).to_pylist()) for i in (2, 3))
            n = max(x.shape[1], y.shape[1])
            x, y = (np.pad(m, ((0, 0), (0, n - m.shape[1]))) for m in (x, y))
            ok = pa.array((x * y).sum(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def _matrix(vectors: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(v, "<f8") for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _padded(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(x.shape[1], y.shape[1])
    return np.pad(x, ((0, 0), (0, n - x.shape[1]))), np.pad(y, ((0, 0), (0, n - y.shape[1])))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _blocked(member: DataFrame) -> DataFrame:
    """``member(label, sign, id, ...)`` with a block of about ``BLOCK`` vectors of one component that are near each other."""
    bits = F.ceil(F.log2(F.greatest(F.count("*") / BLOCK, F.lit(1.0)))).cast("int")
    cells = member.join(member.groupBy("label").agg(bits.alias("bits")), "label").withColumn("cell", F.expr("shiftright(sign, 63 - bits)")).drop("bits")
    parts = cells.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    return cells.join(parts, ["label", "cell"]).withColumn("block", F.concat_ws("-", "cell", part)).drop("cell", "parts")


def _centre(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centre and radius (an angle) of a block, and how many copies it stands for."""
    x = _matrix(pdf["vec"].tolist())
    m = x.mean(axis=0)
    norm = np.sqrt((m * m).sum())
    m = m / norm if norm > 1e-9 else x[0]
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "block": pdf["block"].iloc[:1], "centre": [m.astype("<f8").tobytes()], "radius": [float(_angle(x @ m).max())], "copies": [int(pdf["copies"].sum())]})


def _centres(blocked: DataFrame) -> DataFrame:
    return blocked.select("label", "block", "vec", "copies").groupBy("label", "block").applyInPandas(_centre, "label long, block string, centre binary, radius double, copies long")


def _decided(threshold: float):
    """Of each pair of blocks: whether all their vectors link (1), none (-1), or it must be seen (0)."""
    limit = float(_angle(np.array(threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _padded(*(_matrix(batch.column(i).to_pylist()) for i in (4, 5)))
            apart, reach = _angle((x * y).sum(axis=1)), np.asarray(batch.column(6))
            kind = np.where(apart + reach < limit - SLACK, 1, np.where(apart - reach > limit + SLACK, -1, 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kind)], ["label", "i", "j", "copies", "kind"])

    return run


def _block_counts(threshold: float):
    """Links between two blocks of one component: how many copies each vector is linked with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if len(left) and len(right):
            x, y = _padded(_matrix(left["vec"].tolist()), _matrix(right["vec"].tolist()))
            near = (x @ y.T >= threshold) & (left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None, :])
            out = (near * right["copies"].to_numpy()[None, :]).sum(axis=1)
        return pd.DataFrame({"id": left["id"].to_numpy(), "links": np.asarray(out, np.int64)})

    return run


def _counted(member: DataFrame, threshold: float) -> DataFrame:
    """(id, links): copies of other vectors that each of ``member(label, id, vec, sign, copies)`` links with."""
    member = c.materialize(_blocked(member), "members")
    centres = c.materialize(_centres(member), "centres")
    left = centres.select("label", F.col("block").alias("i"), F.col("centre").alias("x"), F.col("radius").alias("r"))
    right = centres.select("label", F.col("block").alias("j"), "copies", F.col("centre").alias("y"), F.col("radius").alias("q"))
    both = left.join(right, "label").select("label", "i", "j", "copies", "x", "y", (F.col("r") + F.col("q")).alias("reach"))
    pairs = c.materialize(both.mapInArrow(_decided(threshold), "label long, i string, j string, copies long, kind int").where("kind >= 0"), "block-pairs")
    whole = pairs.where("kind = 1").groupBy("label", F.col("i").alias("block")).agg(F.sum("copies").alias("all"), F.max(F.col("i") == F.col("j")).alias("own"))
    sure = member.select("label", "block", "id", "copies").join(whole, ["label", "block"]).select("id", (F.col("all") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"))
    seen = pairs.where("kind = 0").select("label", "i", "j")
    vec = member.select("label", "block", "id", "vec", "copies")
    x = seen.join(vec.withColumnRenamed("block", "i"), ["label", "i"]).select("label", "i", "j", F.lit(0).alias("side"), "id", "vec", "copies")
    y = seen.join(vec.withColumnRenamed("block", "j"), ["label", "j"]).select("label", "i", "j", F.lit(1).alias("side"), "id", "vec", "copies")
    compared = x.unionAll(y).groupBy("label", "i", "j").applyInPandas(_block_counts(threshold), "id long, links long")
    return sure.unionAll(compared).groupBy("id").agg(F.sum("links").alias("links"))


def _reached(threshold: float):
    """Blocks of other components that a vector may link into."""
    limit = float(_angle(np.array(threshold)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "label": pd.Series([], dtype="int64"), "block": pd.Series([], dtype="object")})
        x, y = _padded(_matrix(left["vec"].tolist()), _matrix(right["vec"].tolist()))
        may = _angle(x @ y.T) <= limit + right["radius"].to_numpy()[None, :] + SLACK
        i, j = np.nonzero(may & (left["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :]))
        return pd.DataFrame({"id": left["id"].to_numpy()[i], "label": right["label"].to_numpy()[j], "block": right["block"].to_numpy()[j]})

    return run


def _across(threshold: float):
    """Components that a link joins, between vectors and one block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        x, y = _padded(_matrix(left["vec"].tolist()), _matrix(right["vec"].tolist()))
        la, lb = left["label"].to_numpy(), right["label"].to_numpy()
        i, j = np.nonzero((x @ y.T >= threshold) & (la[:, None] != lb[None, :]))
        return pd.DataFrame({"a": np.minimum(la[i], lb[j]), "b": np.maximum(la[i], lb[j])}).drop_duplicates()

    return run


def _merged(prepared: DataFrame, labels: DataFrame, some: DataFrame | None, threshold: float) -> DataFrame:
    """``labels`` after the vectors of ``some(id)`` (None: all) were compared with all outside their component."""
    every = prepared.select("id", "vec", F.col("signs")[0].alias("sign"), F.lit(1).alias("copies")).join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
    every = c.materialize(every.withColumn("label", F.coalesce("label", "id")), "labelled")
    asked = c.materialize(_blocked(every if some is None else every.join(some, "id", "left_semi")), "saturated")
    centres = c.materialize(_centres(asked), "centres")
    wide, high = (max(1, -(-t.count() // BLOCK)) for t in (centres, every))
    chunk = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = F.lit(None)
    left = every.select(chunk(high, "id").alias("i"), numbers(wide).alias("j"), F.lit(0).alias("side"), "id", "label", "vec", nothing.cast("string").alias("block"), nothing.cast("double").alias("radius"))
    right = centres.select(numbers(high).alias("i"), chunk(wide, "label", "block").alias("j"), F.lit(1).alias("side"), nothing.cast("long").alias("id"), "label", F.col("centre").alias("vec"), "block", "radius")
    reached = c.materialize(left.unionAll(right).groupBy("i", "j").applyInPandas(_reached(threshold), "id long, label long, block string"), "reached")
    parts = reached.groupBy("label", "block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = reached.join(parts, ["label", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("id", F.col("label").alias("of"), "block", "part")
    x = dealt.join(every.select("id", "label", "vec"), "id").select("of", "block", "part", F.lit(0).alias("side"), "label", "vec")
    y = asked.join(parts, ["label", "block"]).select(F.col("label").alias("of"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "label", "vec")
    joined = c.materialize(x.unionAll(y).groupBy("of", "block", "part").applyInPandas(_across(threshold), "a long, b long").distinct(), "across")
    if joined.isEmpty():
        return labels
    moved = c.connected(joined, "merged").select(F.col("node").alias("old"), F.col("label").alias("new"))
    # A label is the least id of its component, so it stands for it among the links, and the least label for the merged one.
    both = every.select(F.col("id").alias("node"), F.col("label").alias("old")).join(moved, "old", "left")
    return c.materialize(both.select("node", F.coalesce("new", "old").alias("label")), "labels")


def _audited(sample: list[tuple[int, bytes]], threshold: float):
    ids = np.array([i for i, _ in sample])
    x = _matrix([v for _, v in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1).to_pylist())
            n = max(x.shape[1], y.shape[1])
            near = np.pad(x, ((0, 0), (0, n - x.shape[1]))) @ np.pad(y, ((0, 0), (0, n - y.shape[1]))).T >= threshold
            i, j = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), batch.column(0).take(pa.array(j))], ["a", "b"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 10, goal: float = 0.97) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors(vec_id, embedding)``."""
    c.small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Equal vectors are one class, with a number that the table fixes.
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = c.materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    trees = 6
    prepared = c.materialize(classes.select("id", "embedding").mapInArrow(_prepared(trees, 7), "id long, vec binary, small binary, signs array<long>"), "prepared")
    vec = prepared.select("id", "vec")
    for attempt in range(3):
        graph = neighbour_graph(prepared, k * 2**attempt, trees, rounds=2 + attempt, near=threshold - 0.02)
        maybe = graph.where(F.col("sim") >= threshold - 0.03).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = maybe.join(vec.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a").join(vec.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b")
        edges = c.materialize(both.select("a", "b", "x", "y").mapInArrow(_exact_edges(threshold), "a long, b long"), "edges")
        labels = c.connected(edges, "vectors")
        # A list with k neighbours near the threshold may have lost links.
        full = graph.where(F.col("sim") >= threshold - 0.02).groupBy(F.col("a").alias("id")).count().where(F.col("count") >= k * 2**attempt).select("id")
        if not full.isEmpty():
            labels = _merged(prepared, labels, full, threshold)
        # Audit: a fixed number of vectors against all others, the recall of each: of all, of those that have links,
        # and of those that have none although their lists hold a vector that is not far.
        linked = vec.join(labels.select(F.col("node").alias("id")), "id", "left_semi")
        close = graph.where(F.col("sim") >= threshold - 0.1).select(F.col("a").alias("id")).distinct()
        lost = vec.join(close, "id", "left_semi").join(labels.select(F.col("node").alias("id")), "id", "left_anti")
        sample = {r["id"]: bytes(r["vec"]) for t in (vec, linked, lost) for r in t.orderBy(F.xxhash64("id", F.lit(attempt))).limit(AUDIT // 2).collect()}
        if not sample:
            break
        true = vec.mapInArrow(_audited(sorted(sample.items()), threshold), "a long, b long").where("a <> b")
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        got = true.join(la, "a", "left").join(lb, "b", "left").groupBy("a").agg((F.count(F.when(F.col("la") == F.col("lb"), 1)) / F.count("*")).alias("recall")).agg(F.min("recall").alias("least")).first()
        if got["least"] is None or got["least"] >= goal:
            break
    else:
        labels = _merged(prepared, labels, None, threshold)
    member = labels.select(F.col("node").alias("id"), "label").join(prepared.select("id", "vec", F.col("signs")[0].alias("sign")), "id").join(classes.select("id", "copies", "first"), "id")
    member = c.materialize(member, "linked")
    counts = _counted(member.drop("first"), threshold)
    named = member.groupBy("label").agg(F.min("first").alias("component_id"))
    usable = prepared.select("id").join(classes.select("id", "first", "copies"), "id").join(counts, "id", "left").join(member.select("id", "label"), "id", "left").join(named, "label", "left")
    usable = usable.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "first").alias("component_id"))
    of_vector = c.materialize(classes.select("id", "embedding").join(usable, "id"), "results")
    out = rows.join(of_vector, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings"))
