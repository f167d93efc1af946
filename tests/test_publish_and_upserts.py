"""Atomic publishing, keyed tables filled by streams, and functions for SQL."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from termloom.plans import sql
from termloom.sources.tables import Registry
from termloom.streaming.upserts import KeyedTable, run_upserts


def test_of_two_writers_one_wins(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    registry.publish("datasets", "d", spark.range(3))

    def write(n):
        try:
            return registry.publish("datasets", "d", spark.range(n), {"n": n}, replace=True)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(2) as pool:
        made = [m for m in pool.map(write, (10, 20)) if m]
    assert made and registry.versions("datasets", "d") == list(range(1, len(made) + 2))
    last = registry.entry("datasets", "d")
    assert registry.read("datasets", "d").count() == last["provenance"]["n"]
    assert registry.read("datasets", "d", 1).count() == 3


def test_a_lost_race_leaves_nothing(spark, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path / "r"))
    registry.publish("datasets", "d", spark.range(3))
    monkeypatch.setattr(Registry, "versions", lambda self, kind, name: [])  # as if the other entry came after the look
    with pytest.raises(FileExistsError, match="another writer"):
        registry.publish("datasets", "d", spark.range(5))
    monkeypatch.undo()
    assert registry.read("datasets", "d").count() == 3
    assert len([p for p in (tmp_path / "r/datasets/d/rows").iterdir()]) == 1
    with pytest.raises(FileNotFoundError):
        registry.read("datasets", "none")


def test_unfinished_rows_are_never_seen(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    registry.publish("datasets", "d", spark.range(3))
    broken = spark.range(9).select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        registry.publish("datasets", "d", broken, replace=True)
    assert registry.read("datasets", "d").count() == 3 and registry.versions("datasets", "d") == [1]


def test_upserts_after_a_restart_equal_one_run(spark, tmp_path):
    rows = [(i % 40, f"v{i}", i) for i in range(200)]
    parts = [rows[:70], rows[70:90], rows[90:]]

    def run(name, steps):
        table = KeyedTable(spark, str(tmp_path / name / "t"), "k", "at")
        for step in steps:
            for part in step:
                spark.createDataFrame(parts[part], "k long, v string, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = spark.readStream.schema("k long, v string, at long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
            out = run_upserts(stream, table, str(tmp_path / name / "c"))
        return table, sorted(tuple(r) for r in out.collect())

    want = sorted((k, f"v{i}", i) for k, i in {r[0]: r[2] for r in rows}.items())
    table, stepped = run("stepped", [[0], [1], [2]])
    assert stepped == want and run("once", [[0, 1, 2]])[1] == want
    table.upsert(spark.createDataFrame(parts[2], "k long, v string, at long"), table._batches()[-1])  # the last batch once more
    assert sorted(tuple(r) for r in table.read().collect()) == want
    table.compact()
    assert sorted(tuple(r) for r in table.read().collect()) == want and len(table._batches()) == 1


def test_a_cache_computes_each_key_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "k")
    asked = spark.sparkContext.accumulator(0)

    def compute(todo):
        asked.add(todo.count())
        return todo.select("k", (F.col("k") * 10).alias("v"))

    for batch, keys in enumerate(([1, 2, 2], [2, 3], [1, 3])):
        table.fill(spark.createDataFrame([(k,) for k in keys], "k long"), batch, compute)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 10), (2, 20), (3, 30)] and asked.value == 3


def test_sql_functions(spark):
    assert set(sql.register(spark)) == {"sentence_chunks", "surface_forms", "semantic_tag", "norm_text"}
    got = spark.sql("SELECT pos, text FROM surface_forms('a (b)', array('x', '', NULL, 'a (b)', 'x'))").collect()
    assert [tuple(r) for r in got] == [(0, "a (b)"), (1, "x")]
    assert spark.sql("SELECT semantic_tag('a (b)') AS t, norm_text(' x y ') AS n").first() == ("b", "xy")
    assert [r["chunk"] for r in spark.sql("SELECT * FROM sentence_chunks('One. Two. Three.', 9, 5)").collect()] == ["One. Two.", "Two. Three."]
