"""Work that takes CPU, not bytes, is done in as many tasks as the shuffles have."""

import threading
import time

from termloom.operators import models


def test_one_file_is_asked_in_many_tasks(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(400).selectExpr("id", "'s' AS system", "cast(id AS string) AS user").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    out = models.complete(rows, lambda system, user: system + user)
    assert out.rdd.getNumPartitions() == n > 1
    assert {(r["id"], r["reply"], r["ok"]) for r in out.collect()} == {(i, f"s{i}", True) for i in range(400)}


def test_threads_share_a_small_batch(spark):
    """Calls of a few rows still run at once."""

    def slow(system, user):
        time.sleep(0.2)
        return threading.current_thread().name

    rows = spark.range(8).selectExpr("id", "'' AS system", "'' AS user").coalesce(1)
    run = models.complete(rows, slow, threads=8)
    assert run.select("reply").distinct().count() > 1
