"""The reachability index against closures by brute force."""

import random

import pytest

from termloom.operators import graph
from termloom.operators.reachability import Reachability, build_reachability


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rnd = random.Random(12)
    edges = [(f"n{i}", f"n{rnd.randrange(max(0, i - 30), i)}") for i in range(1, 120) if i != 60]
    edges += [(f"n{i}", f"n{rnd.randrange(0, i)}") for i in range(1, 120, 4)] + [("n5", "n5"), edges[3]]
    path = str(tmp_path_factory.mktemp("reach") / "i")
    totals = build_reachability(spark.createDataFrame(edges, "child string, parent string").repartition(3), path)
    up = {}
    for c, p in edges:
        if c != p:
            up.setdefault(c, set()).add(p)

    def above(n):
        out, todo = set(), [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in out:
                    out.add(p)
                    todo.append(p)
        return out

    return edges, {f"n{i}": above(f"n{i}") for i in range(120)}, Reachability(spark, path), totals


def test_closures(spark, made):
    edges, above, index, totals = made
    assert totals["nodes"] == 120 and 120 < totals["intervals"] < sum(map(len, above.values()))
    every = spark.createDataFrame([(n,) for n in [*above, "nowhere"]], "node string")
    assert {tuple(r) for r in index.ancestors(every).collect()} == {(n, a) for n, x in above.items() for a in x}
    want = {(a, n) for n, x in above.items() for a in x} | {(n, n) for n in above} | {("nowhere", "nowhere")}
    got = [tuple(r) for r in index.descendants(every).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in index.descendants(every, inclusive=False).collect()} == {p for p in want if p[0] != p[1]}


def test_pairs(spark, made):
    edges, above, index, _ = made
    rnd = random.Random(1)
    asked = [(f"n{rnd.randrange(120)}", f"n{rnd.randrange(120)}") for _ in range(300)] + [("n0", "nowhere"), ("nowhere", "nowhere")]
    got = {(r["above"], r["below"]): r["holds"] for r in index.is_below(spark.createDataFrame(asked, "above string, below string")).collect()}
    assert got == {(a, b): a == b or a in above.get(b, ()) for a, b in asked}
    common = {(r["a"], r["b"]): r["common"] for r in index.deepest_common(spark.createDataFrame(asked[:150], "a string, b string")).collect()}
    for (a, b), c in common.items():
        both = (above[a] | {a}) & (above[b] | {b})
        assert c == (min(both, key=lambda x: (-len(above[x]), x)) if both else None)


def test_coherence_and_scope_from_the_index(spark, made):
    edges, _, index, _ = made
    e = spark.createDataFrame(edges, "child string, parent string")
    cand = spark.createDataFrame([(q, r, f"n{(q * 31 + r * 17) % 120}") for q in range(20) for r in range(1, 4)] + [(99, 1, "n7")], "query_id long, rank int, node string")
    plain = {tuple(r) for r in graph.coherence(cand, graph.ancestor_closure(e)).collect()}
    assert {tuple(r) for r in graph.indexed_coherence(cand, index).collect()} == plain
    for expression in ("<<n3 OR <n5", "(<<n0 MINUS <<n2) AND <n1", "<<nowhere", "n4"):
        assert {r["node"] for r in graph.scope(expression, index).collect()} == {r["node"] for r in graph.scope(expression, e).collect()}


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "a")], [("b", "a"), ("c", "b"), ("b", "c"), ("d", "c")]])
def test_cycles_are_errors(spark, tmp_path, edges):
    with pytest.raises(ValueError, match="cycle"):
        build_reachability(spark.createDataFrame(edges, "child string, parent string"), str(tmp_path / "i"))


def test_the_index_is_not_broadcast(spark, tmp_path):
    from pyspark.sql import functions as F

    edges = spark.range(1, 2000).select(F.concat(F.lit("n"), "id").alias("child"), F.concat(F.lit("n"), F.floor(F.col("id") / 10).cast("string")).alias("parent"))
    build_reachability(edges, f"{tmp_path}/i")
    index = Reachability(spark, f"{tmp_path}/i")
    roots = spark.createDataFrame([("n1",), ("none",)], "node string")
    below = index.descendants(roots)
    assert below.where("root = 'n1'").count() == 1 + 10 + 100 + 1000
    assert below.where("root = 'none'").count() == 1
    for df in (below, index.ancestors(roots)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
