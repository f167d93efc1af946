"""Keyed tables and bilingual pairs: first or last wins, pooling, joins, grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def last_wins(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """A keyed table: the last row of each key by position."""
    return first_by(df, [key], [F.desc(pos)])


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pos, en, target): stripped, blanks dropped, first of each (lower en, target); the casing stays."""
    p = pairs.withColumn("en", T.text_or_empty(F.col("en"))).withColumn("target", T.text_or_empty(F.col("target")))
    return first_by(p.where((F.col("en") != "") & (F.col("target") != "")), [F.lower("en"), "target"], ["pos"])


def pool_sources(pairs: DataFrame, priority: Sequence[str]) -> DataFrame:
    """pairs(pos, en, target, source) of all sources: of equal pairs the one of the first source stays."""
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(priority)], F.lit(len(priority)))
    p = pairs.withColumn("en", T.text_or_empty(F.col("en"))).withColumn("target", T.text_or_empty(F.col("target"))).withColumn("_rank", rank)
    return first_by(p.where((F.col("en") != "") & (F.col("target") != "")), [F.lower("en"), "target"], ["_rank", "pos"]).drop("_rank")


def pool_distinct(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name, rows with nulls dropped, distinct."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.na.drop().distinct()


def surface_gold(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Gold by surface form: terms(sctid, pos, kind, surface, tag) joined with pairs(pos, en, target).

    Of equal surfaces the first by (position, kind) is the term; the first target of a concept stays.
    """
    key = F.lower(T.text_or_empty(F.col("surface")))
    names = first_by(terms.withColumn("key", key).where("key <> ''"), ["key"], ["pos", "kind"]).select("key", "sctid", "tag")
    p = pairs.select(F.lower(T.text_or_empty(F.col("en"))).alias("key"), "en", "target", F.col("pos").alias("pair_pos"))
    return first_by(p.join(names, "key"), ["sctid"], ["pair_pos"]).select("sctid", "target", F.col("tag").alias("hierarchy"), "en")


def preferred(rows: DataFrame, key: str, value: str, first: Column, pos: str = "pos") -> DataFrame:
    """One value per key: rows for which ``first`` holds come before others, then by position."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct((~first).cast("int"), F.col(pos), F.col(value).alias("_tie"))).alias(value))


def acceptable_terms(rows: DataFrame, key: str, term: str, pos: str = "pos") -> DataFrame:
    """All distinct terms of each key in order of position, joined by '; '."""
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pos, term))), lambda x: x[term]))
    return rows.groupBy(key).agg(F.array_join(listed, "; ").alias("acceptables"))


def unpivot_parts(df: DataFrame, keys: Sequence[str], left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Columns of parts in two languages to rows (part, en, target); both sides must be filled."""
    cells = [F.struct(F.lit(i).alias("part"), F.col(a).cast("string").alias("en"), F.col(b).cast("string").alias("target")) for i, (a, b) in enumerate(zip(left, right, strict=True))]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    return rows.where((T.text_or_empty(F.col("en")) != "") & (T.text_or_empty(F.col("target")) != ""))


def zip_tables(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """Row i with row i of two tables that carry their positions; the longer one's rest goes."""
    return a.join(b, pos)


def fill_left(base: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins; what is missing becomes ''."""
    out = base
    for o in others:
        out = out.join(o, key, "left")
    return out.na.fill("")


def regression_set(before: DataFrame, after: DataFrame, key: str, seed: str, limit: int) -> DataFrame:
    """Rows that were exact and no longer are: a sample of fixed size in hashed order."""
    worse = before.where("exact").select(key).join(after.where("not exact"), key)
    return worse.withColumn("_h", hashed(F.col(key), seed)).orderBy("_h").limit(limit).drop("_h")


def consensus(a: DataFrame, b: DataFrame, key: str, label: str, wanted: str) -> DataFrame:
    """Keys that both judges gave the wanted label."""
    return a.where(F.col(label) == wanted).select(key).join(b.where(F.col(label) == wanted).select(key), key)


def hashed(c: Column, seed: str) -> Column:
    """A reproducible order: md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(seed), c.cast("string")).cast("binary"))


def group_candidates(rows: DataFrame, key: str, text: str, pos: str = "pos") -> DataFrame:
    """Samples of each key grouped by normalised text: (key, n_samples, n_distinct, candidates, top_candidate).

    Empty and error rows are dropped; a group shows its first spelling; groups are
    ordered by count, then by first appearance.
    """
    ok = rows.where((T.text_or_empty(F.col(text)) != "") & ~F.col(text).startswith("ERROR"))
    per = ok.groupBy(F.col(key), T.norm_text(F.col(text)).alias("_norm")).agg(F.count("*").alias("count"), F.min_by(text, pos).alias("text"), F.min(pos).alias("_first"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("a"), F.col("_first").alias("b"), F.col("text").alias("t"))))
    out = per.groupBy(key).agg(F.sum("count").alias("n_samples"), F.count("*").alias("n_distinct"), F.transform(order, lambda x: F.struct(x["t"].alias("text"), (-x["a"]).alias("count"))).alias("candidates"))
    return out.withColumn("top_candidate", F.col("candidates")[0]["text"])


def majority_vote(rows: DataFrame, key: str, text: str, pos: str = "pos") -> DataFrame:
    """The most frequent spelling of the most frequent normalised form; first seen among equals."""
    ok = rows.where(T.text_or_empty(F.col(text)) != "").withColumn("_norm", T.norm_text(F.col(text)))
    spell = ok.groupBy(key, "_norm", F.col(text).alias("_text")).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    form = spell.groupBy(key, "_norm").agg(F.sum("n").alias("total"), F.min("first").alias("form_first"), F.max_by("_text", F.struct("n", -F.col("first"))).alias(text))
    return first_by(form, [key], [F.desc("total"), "form_first"]).select(key, text, F.col("total").alias("votes"))


def info_counts(rows: DataFrame, info: DataFrame, key: str, target: str) -> DataFrame:
    """One row: how many rows there are, how many have no target, and of the others how many ``info`` knows or lacks."""
    known = rows.join(info.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    filled, have = T.text_or_empty(F.col(target)) != "", F.col("_known").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return known.agg(F.count("*").alias("n"), n(~filled).alias("blank"), n(filled & ~have).alias("missing"), n(filled & have).alias("joined"))
