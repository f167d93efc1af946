"""Samples with quotas, splits, even spreads; all reproducible by hashed order, none by a random state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered, running
from .pairs import first_by, hashed


def quotas(total: int, strata: Sequence[str]) -> dict[str, int]:
    """The total over the strata in order; the remainder goes to the first ones."""
    each, rest = divmod(total, len(strata)) if strata else (0, 0)
    return {s: each + (i < rest) for i, s in enumerate(strata)}


def stratified(rows: DataFrame, stratum: str, key: str, quota: dict[str, int], seed: str) -> DataFrame:
    """Up to the quota of each stratum, in hashed order of the key."""
    take = F.coalesce(*[F.when(F.col(stratum) == s, n) for s, n in quota.items()], F.lit(0))
    w = Window.partitionBy(stratum).orderBy(hashed(F.col(key), seed), key)
    most = max(quota.values(), default=0)  # a literal, so that groups are cut before they are shuffled
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= most).where(F.col("draw") <= take)


def split_holdout(rows: DataFrame, key: str, stratum: str, seed: str, cap: int = 300, share: float = 0.8, exclude: DataFrame | None = None) -> DataFrame:
    """Training and held-out rows: excluded keys out, at most ``cap`` a stratum, the first ``share`` of them train."""
    left = rows.join(exclude.select(key), key, "left_anti") if exclude is not None else rows
    w = Window.partitionBy(stratum).orderBy(hashed(F.col(key), seed), key)
    drawn = left.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= cap)
    n = F.count("*").over(Window.partitionBy(stratum))
    return drawn.withColumn("split", F.when(F.col("draw") <= F.floor(n * share), "train").otherwise("holdout"))


def first_stratum(conditions: Sequence[tuple[str, Column]], rest: str | None = None) -> Column:
    """The first condition that holds names the stratum."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in conditions], F.lit(rest))


def spread(rows: DataFrame, order: Sequence[str | Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """k rows evenly spread over the order: indices (i * step) mod n for i < k, step = max(1, n // k); all if n <= k."""
    x = running(rows, order, F.lit(1), by, "_i").withColumnRenamed("_i_all", "_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    keep = (F.col("_n") <= k) | ((F.col("_i") % step == 0) & (F.col("_i") / step < k))
    return x.where(keep).drop("_i", "_n")


def minimal_pairs(rows: DataFrame, text: str, pattern: str, key: str, cap: int = 60) -> DataFrame:
    """Texts that differ in one feature only: the feature is masked, groups of two variants or more give their first two.

    Of equal variants in a group the last row by key stands.
    """
    feature = F.regexp_extract(text, f"({pattern})", 1)
    x = rows.where(F.col(text).rlike(pattern)).withColumn("variant", feature).withColumn("mask", F.regexp_replace(text, pattern, "█"))
    one = first_by(x, ["mask", "variant"], [F.desc(key)])
    per = one.groupBy("mask").agg(F.array_sort(F.collect_list(F.struct("variant", key, text))).alias("v")).where(F.size("v") > 1)
    first = per.orderBy("mask").limit(cap)
    return first.select("mask", F.col("v")[0]["variant"].alias("variant_a"), F.col("v")[0][text].alias("text_a"), F.col("v")[1]["variant"].alias("variant_b"), F.col("v")[1][text].alias("text_b"))


def diverse_by_bucket(rows: DataFrame, bucket: str, key: str, per_bucket: int, total: int) -> DataFrame:
    """An even spread within each bucket, then over all of them, larger buckets first."""
    sized = rows.join(rows.groupBy(bucket).agg(F.count("*").alias("_size")), bucket)
    inner = spread(sized, [key], per_bucket, by=[bucket])
    return spread(inner, [F.desc("_size"), bucket, key], total).drop("_size")


def longest_notes(rows: DataFrame, stratum: str, note: str, last: Column, key: str, least: int = 40, n: int = 6) -> DataFrame:
    """The first n notes longer than ``least`` of each stratum: rows for which ``last`` holds come after, longer first."""
    ok = rows.where(F.length(note) > least)
    w = Window.partitionBy(stratum).orderBy(last.cast("int"), F.desc(F.length(note)), key)
    return ok.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def by_length(rows: DataFrame, text: str, key: str, most: int = 80, n: int | None = None) -> DataFrame:
    """Rows with a text of at most ``most`` characters, shorter ones first: ``place`` counts from 1; the first ``n`` if given."""
    short = rows.where((F.length(text) > 0) & (F.length(text) <= most))
    if n is not None:
        short = short.orderBy(F.length(text), key).limit(n)
    return numbered(short, [F.length(text), key])


def blind_left(key: Column) -> Column:
    """Whether arm A stands left: the parity of md5(id)."""
    return F.conv(F.right(F.md5(key.cast("string").cast("binary")), F.lit(1)), 16, 10).cast("int") % 2 == 0


def two_passes(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Each row twice: in a coin's order, and swapped."""
    coin = F.conv(F.right(hashed(F.col(key), seed), F.lit(1)), 16, 10).cast("int") % 2 == 0
    modes = F.array(F.struct(F.lit("primary").alias("mode"), coin.alias("left_is_a")), F.struct(F.lit("swap").alias("mode"), (~coin).alias("left_is_a")))
    return rows.withColumn("_m", F.explode(modes)).select(*rows.columns, "_m.*")


def sequential_pools(pools: Sequence[tuple[str, DataFrame, int]], key: str, seed: str) -> DataFrame:
    """Quotas from pools in turn, without repeating a key: a pool loses what earlier ones took."""
    taken = None
    for name, pool, n in pools:
        left = pool.select(key).distinct()
        if taken is not None:
            left = left.join(taken.select(key), key, "left_anti")
        drawn = left.orderBy(hashed(F.col(key), seed), key).limit(n).withColumn("pool", F.lit(name))
        taken = drawn if taken is None else taken.unionByName(drawn)
    return taken


def extremes(rows: DataFrame, value: str, key: str, worst: int = 30, best: int = 10) -> DataFrame:
    """The first ``worst`` rows by value, and the last ``best`` if there are more than that."""
    low = rows.orderBy(value, key).limit(worst).withColumn("end", F.lit("worst"))
    high = rows.orderBy(F.desc(value), F.desc(key)).limit(best).withColumn("end", F.lit("best"))
    return low.unionByName(high)
