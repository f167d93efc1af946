"""Summaries of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import descendants
from .pairs import first_by


def dimension_means(rows: DataFrame, dimensions: Sequence[str], by: Sequence[str], least: int = 1) -> DataFrame:
    """Means of several scores by group, for groups of at least ``least`` rows."""
    means = [F.round(F.avg(d), 6).alias(f"mean_{d}") for d in dimensions]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *means).where(F.col("n") >= least)


def source_split(rows: DataFrame, value: str, exact: str, splits: dict[str, Column]) -> DataFrame:
    """One row: n, mean value and share of exact, overall and within each split."""
    out = []
    for name, cond in ({"all": F.lit(True)} | splits).items():
        out += [F.sum(cond.cast("long")).alias(f"{name}_n"), F.round(F.avg(F.when(cond, F.col(value))), 6).alias(f"{name}_mean"), F.round(F.avg(F.when(cond, F.col(exact).cast("double"))), 6).alias(f"{name}_exact")]
    return rows.agg(*out)


def label_counts(rows: DataFrame, label: str, cost: str) -> DataFrame:
    """Rows and total cost per label."""
    return rows.groupBy(F.coalesce(F.col(label), F.lit("(none)")).alias("label")).agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))


def round_trip(found: DataFrame, ceiling: DataFrame) -> DataFrame:
    """Recovery by back-translation against the ceiling of gold queries: found and ceiling(id, recovered, score)."""
    both = found.select("id", F.col("recovered").alias("r"), F.col("score").alias("s")).join(ceiling.select("id", F.col("recovered").alias("c")), "id")
    n = F.count("*")
    return both.agg(n.alias("n"), F.round(F.avg(F.col("r").cast("double")), 6).alias("recovery"), F.round(F.avg(F.col("c").cast("double")), 6).alias("ceiling"), F.round(F.avg(F.when(F.col("r") == 1, F.col("s"))), 6).alias("mean_recovered_score"), F.sum(((F.col("c") == 1) & (F.col("r") == 0)).cast("long")).alias("lost"))


def groups_with_rest(rows: DataFrame, group: str, least: int, value: str) -> DataFrame:
    """Means of groups of at least ``least`` rows; smaller ones together as '(other)', blank names as '(no tag)'."""
    named = rows.withColumn("_g", F.when(T.text_or_empty(F.col(group)) == "", "(no tag)").otherwise(F.col(group)))
    big = named.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_g", F.lit(1).alias("_big"))
    joined = named.join(big, "_g", "left").withColumn("name", F.when(F.col("_big") == 1, F.col("_g")).otherwise("(other)"))
    return joined.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def split_means(rows: DataFrame, group: str, least: int, values: Sequence[str], split: str) -> DataFrame:
    """Means of several values by group and split; groups of fewer than ``least`` rows together as '(other)', blank names as '(no tag)'."""
    named = rows.withColumn("_g", F.when(T.text_or_empty(F.col(group)) == "", "(no tag)").otherwise(F.col(group)))
    big = named.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_g", F.lit(1).alias("_big"))
    joined = named.join(big, "_g", "left").withColumn("name", F.when(F.col("_big") == 1, F.col("_g")).otherwise("(other)"))
    return joined.groupBy("name", split).agg(F.count("*").alias("n"), *[F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values])


def eval_set(edges: DataFrame, roots: DataFrame, terms: DataFrame, preferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage): descendants of the roots with a term and a preferred target; ids ordered as numbers.

    ``terms(sctid, en)``, ``preferred(sctid, target)``; coverage is one row (concepts, with_target, share).
    """
    below = descendants(edges, roots).select(F.col("node").alias("sctid")).distinct().join(terms, "sctid")
    both = below.join(preferred, "sctid", "left")
    rows = both.where("target is not null").orderBy(F.col("sctid").try_cast("bigint"), "sctid")
    hit = F.count("target")
    return rows, both.agg(F.count("*").alias("concepts"), hit.alias("with_target"), F.round(F.coalesce(F.try_divide(hit.cast("double"), F.count("*")), F.lit(0.0)), 6).alias("share"))


def site_lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows left-joined by lower key with table(pos, key, term, others): 'term (also: a, b)'; of equal keys the last stands."""
    last = first_by(table.withColumn("_k", F.lower(T.text_or_empty(F.col("key")))), ["_k"], [F.desc("pos")])
    shown = F.when(F.size("others") > 0, F.concat("term", F.lit(" (also: "), F.array_join("others", ", "), F.lit(")"))).otherwise(F.col("term"))
    return rows.withColumn("_k", F.lower(T.text_or_empty(F.col(key)))).join(last.select("_k", shown.alias("site")), "_k", "left").drop("_k").na.fill("", ["site"])


def axis_compare(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Two runs side by side: of several candidate columns the first that is filled counts."""
    value = lambda d: F.coalesce(*[F.nullif(T.text_or_empty(F.col(c)), F.lit("")) for c in columns if c in d.columns])
    return before.select(key, value(before).alias("before")).join(after.select(key, value(after).alias("after")), key).withColumn("same", F.col("before").eqNullSafe(F.col("after")).cast("int"))
