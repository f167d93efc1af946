"""Places and running sums over a whole table, without a window that one task would have to hold.

Rows are dealt by range of the order and written once with the number of their range; the sums of
ranges (at most one row a range and group) give each range its offset; only ranges are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def widened(df: DataFrame, *keys: str) -> DataFrame:
    """At least as many partitions as the shuffles have: the work here is in proportion to CPU, not to bytes,
    so neither a scan of few row groups nor coalescing by size should narrow it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys or df.rdd.getNumPartitions() < n else df


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as the shuffles have, without asking how many there are, which would run joins."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running(df: DataFrame, order: Sequence[str | Column], value: str | Column, by: Sequence[str] = (), into: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group that stand before, in ``into``.

    ``order`` must be total within a group, or equal places get their sums in any order. The sum of the group is in ``into``_all.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    amount = F.col(value) if isinstance(value, str) else value
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("_value", F.coalesce(amount, F.lit(0)))
    rows = rows.repartitionByRange(ranges, *by, *keys).withColumn("_range", F.spark_partition_id())
    rows = checkpointed(rows, "ranges")
    sums = rows.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    group = Window.partitionBy(*(by or [F.lit(0)]))  # one row for each range
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = checkpointed(sums.withColumn(f"{into}_all", F.sum("_sum").over(group)).drop("_sum"), "offsets")
    alike = [rows[k].eqNullSafe(sums[k]) for k in by] + [rows["_range"] == sums["_range"]]
    joined = rows.join(sums, alike).select(*[rows[c] for c in rows.columns], "_offset", f"{into}_all")
    within = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn(into, F.col("_offset") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return out.drop("_value", "_range", "_offset")


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), into: str = "place") -> DataFrame:
    """``df`` with each row's place in its group, from 1 on, in ``into``."""
    return running(df, order, F.lit(1), by, "_n").withColumn(into, (F.col("_n") + 1).cast("long")).drop("_n", "_n_all")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, q0, q1, ...) exact quantiles, interpolated between neighbours as by rank (n - 1) * share; nulls do not count.

    Equal values are counted first; the value at a rank is that of the row whose count covers it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    placed = running(counts, ["_v"], "_k", by, "_below")
    aggs = [F.sum("_k").alias("n")]
    for i, share in enumerate(shares):
        rank = (F.col("_below_all") - 1) * F.lit(float(share))
        for name, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            aggs.append(F.max(F.when((F.col("_below") <= at) & (at < F.col("_below") + F.col("_k")), F.col("_v"))).alias(f"_{name}{i}"))
        aggs.append(F.max(rank - F.floor(rank)).alias(f"_part{i}"))
    found = placed.groupBy(*by).agg(*aggs)
    return found.select(*by, "n", *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(f"q{i}") for i in range(len(shares))])
