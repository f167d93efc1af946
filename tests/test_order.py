"""Running sums, places and quantiles without a window over all rows; places of rows in files."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import metrics, order, sampling
from termloom.plans import config, flow
from termloom.plans import functions as _registered  # noqa: F401
from termloom.sources import files, positions


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(2)
    return [(i, rnd.choice(["a", "b", None]), rnd.choice([None, 0.5, 1.0, float(rnd.randrange(40))]), rnd.randrange(5)) for i in range(700)]


def test_running_and_numbered(spark, made):
    df = spark.createDataFrame(made, "id long, g string, v double, n long")
    for by in ([], ["g"]):
        sums, totals = defaultdict(int), defaultdict(int)
        want = {}
        for i, g, _v, n in sorted(made, key=lambda r: -r[0]):
            k = g if by else 0
            want[i] = (sums[k], totals[k] + 1)
            sums[k] += n
            totals[k] += 1
        got = {r["id"]: (r["before"], r["before_all"], r["g"]) for r in order.running(df, [F.desc("id")], "n", by).collect()}
        assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
        assert all(x[1] == sums[x[2] if by else 0] for x in got.values())
        assert {r["id"]: r["place"] for r in order.numbered(df, [F.desc("id")], by).collect()} == {i: x[1] for i, x in want.items()}
    assert order.numbered(df.limit(0), ["id"]).count() == 0


def test_quantiles(spark, made):
    df = spark.createDataFrame(made, "id long, g string, v double, n long")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    for r in order.quantiles(df, "v", shares, ["g"]).collect():
        values = [v for _, g, v, _ in made if g == r["g"] and v is not None]
        assert r["n"] == len(values)
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(values, shares).tolist())
    lone = spark.createDataFrame([("a", None), ("b", 3.0)], "g string, v double")
    assert {tuple(r) for r in metrics.percentiles(lone, "v", ["g"]).collect()} == {("a", None, None, None), ("b", 3.0, 3.0, 3.0)}


def test_no_single_partition_over_rows(spark, made):
    """Only rows of ranges meet in one task, never those of the table."""
    df = spark.createDataFrame(made, "id long, g string, v double, n long").where("v is not null")
    for out in (metrics.auc(df.withColumn("l", (F.col("n") > 2).cast("int")), "v", "l"), sampling.by_length(df.withColumn("t", F.col("v").cast("string")), "t", "id"), metrics.top_coverage_precision(df, "v", "n", 0.3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange SinglePartition" not in plan or "HashAggregate" in plan  # a final one-row aggregate
        assert "Window" not in plan or "_range" in plan


def test_positions(spark, tmp_path):
    rows = [(str(random.Random(i).randrange(10**6)), f"x{i}") for i in range(5000)]
    spark.createDataFrame(rows, "id string, t string").repartition(3).write.option("header", True).option("sep", "\t").csv(str(tmp_path / "f"))
    parts = sorted(p for p in (tmp_path / "f").iterdir() if p.name.startswith("part"))
    lines = [line.split("\t")[1] for p in parts for line in p.read_text().splitlines()[1:]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = positions.positioned(files.read_tsv(spark, str(tmp_path / "f"), ["id", "t"]))
            assert [r["t"] for r in got.orderBy("pos").collect()] == lines
            assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_flows_go_by_file_order(spark, tmp_path):
    """The last row of a key wins and the first keys count, as they stand in the file."""
    (tmp_path / "t.csv").write_text("sctid,en,target\n9,Nine,bad\n1,One,bad\n9,Nine,good\n5,Five,x\n1,One,good\n")
    (tmp_path / "r.csv").write_text("sctid,target\n5,old\n9,good\n1,good\n5,x\n")
    env = {"sources": {"t": {"path": str(tmp_path / "t.csv")}, "r": {"path": str(tmp_path / "r.csv")}}}
    spec = {"nodes": [{"id": "t", "type": "datasource", "params": {"source": "t"}}, {"id": "r", "type": "datasource", "params": {"source": "r"}}, {"id": "e", "type": "evaluate", "params": {"limit": None}, "inputs": {"translations": "t", "reference": "r"}}]}
    for limit, keys in ((None, {"5", "9", "1"}), (2, {"5", "9"}), (1, {"5"})):
        spec["nodes"][2]["params"]["limit"] = limit
        nodes, ctx = config.assemble(spark, spec, env, {})
        got = flow.run(nodes, ctx)["e"].outputs["rows"].collect()
        assert {(r["sctid"], r["candidate"], r["best_ref"], r["exact"]) for r in got} == {(k, "x" if k == "5" else "good", "x" if k == "5" else "good", 1) for k in keys}
    spec = {"nodes": [{"id": "t", "type": "datasource", "params": {"source": "t"}}, {"id": "g", "type": "style_guide", "params": {"guide": "g"}}, {"id": "u", "type": "translate", "params": {"model_key": "m", "limit": 2}, "inputs": {"terms": "t", "exemplars": "t", "style_guide": "g"}}]}
    nodes, ctx = config.assemble(spark, spec, env | {"guides": {"g": "x"}}, {"m": lambda s, u: "y"})
    assert sorted(r["sctid"] for r in flow.run(nodes, ctx)["u"].outputs["translations"].collect()) == ["1", "9"]


def test_crawl_has_no_end_but_the_last_page(spark):
    pages = spark.createDataFrame([(f"p{i}", f'<a href="p{i + 1}">x</a>') for i in range(45)], "url string, html string")
    assert files.crawl(pages, spark.createDataFrame([("p0",)], "url string")).count() == 45
