"""Scoring takes CPU, not bytes: it is done in as many tasks as the shuffles have, equal pairs once a batch."""

from pyspark.sql import functions as F

from termloom.functions import similarity as S
from termloom.operators import metrics


def _tasks(df):
    return len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()})


def test_scoring_is_spread(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = spark.range(2000).selectExpr("cast(id AS string) AS sctid", "0 AS pos")
    scored = metrics.score_rows(some.withColumn("candidate", F.concat(F.lit("a b "), "sctid")), some.withColumn("refs", F.array(F.concat(F.lit("a c "), "sctid"))))
    assert _tasks(scored) == n


def test_equal_pairs_are_scored_once(monkeypatch):
    import pandas as pd

    calls = []
    plain = S._sentence_chrf
    monkeypatch.setattr(S, "_sentence_chrf", lambda a, b: calls.append((a, b)) or plain(a, b))
    got = S._best_chrf(pd.Series(["ab", "ab", None, "ab"]), pd.Series([["ab", "b"], ["b", "ab"], ["ab"], None]))
    assert got.values.tolist() == [[100.0, "ab"], [100.0, "ab"], [0.0, "ab"], [0.0, None]]
    assert len(calls) == 3
