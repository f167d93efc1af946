"""Consistency analyses of terms along attribute axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import first_attribute


def site_usage(rows: DataFrame, sites: Sequence[str], text: str, forms: Sequence[str]) -> DataFrame:
    """Per site (first non-blank of several columns) with two or more rows: the forms used, if they are two or more."""
    x = rows.withColumn("site", first_attribute(sites)).where("site is not null").withColumn("form", T.longest_form(F.col(text), forms))
    per = x.groupBy("site").agg(F.count("*").alias("n"), F.count_distinct("form").alias("n_forms"), F.array_join(F.array_sort(F.collect_set("form")), "|").alias("forms"))
    return per.where("n >= 2 and n_forms >= 2")


def modality_variants(rows: DataFrame, method: str, text: str, forms: Sequence[str], key: str, examples: int = 3) -> DataFrame:
    """Per method and form: counts and first examples, for methods with two variants, or with one and unmatched rows."""
    x = rows.withColumn("form", T.longest_form(F.col(text), forms))
    per = x.groupBy(method).agg(F.count("*").alias("n"), F.count_distinct("form").alias("n_variants"), F.sum(F.col("form").isNull().cast("long")).alias("unmatched"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("form").isNotNull(), F.struct(F.col(key).alias("k"), F.col(text).alias("t"))))), 1, examples), lambda e: e["t"]), "|").alias("examples"))
    return per.where("n_variants >= 2 or (n_variants >= 1 and unmatched > 0)")


def terminal_suffixes(rows: DataFrame, method: str, text: str, suffixes: Sequence[str]) -> DataFrame:
    """Per method the classes of the last token's suffix, for methods with two or more."""
    last = F.element_at(F.split(T.strip(F.col(text)), r"\s+"), -1)
    x = rows.withColumn("suffix", T.suffix_bucket(last, suffixes))
    per = x.groupBy(method, "suffix").agg(F.count("*").alias("n"))
    kinds = per.groupBy(method).agg(F.count("*").alias("kinds")).where("kinds >= 2").select(method)
    return per.join(kinds, method, "left_semi")


def contrast_order(rows: DataFrame, en: str, target: str, en_pattern: str, target_pattern: str) -> DataFrame:
    """How many terms of the kind put the contrast first, and how many the site."""
    x = rows.withColumn("ordering", T.contrast_order(F.col(en), F.col(target), en_pattern, target_pattern)).where("ordering is not null")
    return x.groupBy("ordering").agg(F.count("*").alias("n"))


def error_patterns(rows: DataFrame, similarity: str, checks: dict[str, Column], bar: dict[str, float]) -> DataFrame:
    """Shares of rows that show each pattern, and whether they pass the bar that makes it a problem."""
    n = F.count("*")
    cols = []
    for name, cond in checks.items():
        share = F.coalesce(F.try_divide(F.sum(cond.cast("long")).cast("double"), n), F.lit(0.0))
        cols += [F.round(share, 6).alias(f"{name}_share"), (share >= bar[name]).cast("int").alias(f"{name}_problem")]
    return rows.agg(n.alias("n"), *cols)
