"""The persisted index gives what comparing all vectors gives, and reads fewer cells."""

import numpy as np
import pytest

from termloom.operators import retrieval
from termloom.operators.vector_index import Index, Visits, build_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + 0.15 * rng.normal(size=12)).tolist()) for i in range(900)]
    rows += [(900, [0.0] * 12), (901, rows[5][1]), (902, (2 * np.array(rows[5][1])).tolist()), (903, None), (904, [1.0, 2.0]), (905, [None] * 12)]
    return spark.createDataFrame(rows, "point_id long, vector array<double>").repartition(4)


def _rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "point_id", "score", "rank").collect())


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_equals_all_vectors(spark, vectors, tmp_path_factory, k):
    path = str(tmp_path_factory.mktemp("index") / "i")
    totals = build_index(vectors, path)
    assert totals == {"rows": 903, "cells": totals["cells"], "width": 12} and totals["cells"] > 10
    queries = vectors.where("point_id % 9 = 0 or point_id > 899").withColumnRenamed("point_id", "query_id")
    good = vectors.where("point_id < 903")
    visits = Visits()
    index = Index(spark, path)
    assert int(index.n.sum()) == 903
    got = _rows(index.search(queries, k, visits=visits))
    assert got == _rows(retrieval.dense_topk(good, queries.where("query_id < 903"), k))
    if k < 100:
        assert visits.read < 0.5 * visits.queries * visits.cells and visits.compared < 0.5 * visits.queries * visits.rows
    assert _rows(index.search(queries, 3, self_match=True)) == _rows(retrieval.dense_topk(good, queries.where("query_id < 903"), 3, self_match=True))
    assert index.search(queries.limit(0), k).count() == 0


def test_cells_are_pruned_at_the_scan(spark, vectors, tmp_path):
    build_index(vectors, str(tmp_path / "i"), cells=20)
    index = Index(spark, str(tmp_path / "i"))
    few = np.zeros(len(index.cell), bool)
    few[[2, 3]] = True
    cells = index._cells(few)
    assert "PartitionFilters: [cell" in cells._jdf.queryExecution().executedPlan().toString()
    assert {r["cell"] for r in cells.select("cell").distinct().collect()} == set(index.cell[few].tolist())


def test_empty_index(spark, vectors, tmp_path):
    assert build_index(vectors.limit(0), str(tmp_path / "i"))["rows"] == 0
    assert Index(spark, str(tmp_path / "i")).search(vectors.withColumnRenamed("point_id", "query_id"), 3).count() == 0


def test_vectors_of_another_width_are_no_hits(spark, vectors):
    queries = vectors.where("point_id = 3").withColumnRenamed("point_id", "query_id")
    hits = {r["point_id"] for r in retrieval.dense_topk(vectors, queries, 2000).collect()}
    assert hits == set(range(903)) - {3}
