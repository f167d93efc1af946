"""Boilerplate removal from a document corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..session import ship
from ..sources.tables import checkpointed
from .order import widened


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lines): markdown stripped, named sections and layout noise out."""
    lines = T.split_lines(T.markdown_strip(F.coalesce(F.col(text), F.lit(""))))
    docs = widened(docs)
    return docs.select("doc_id", F.filter(T.skip_sections(lines), lambda x: ~T.is_layout_noise(x)).alias("lines"))


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, place, title, body) of the first-level headings of each document, in order.

    Text before the first heading goes; of a repeated title the last body stays, at the place of the first.
    """
    whole = F.concat(F.lit("\n"), F.array_join(T.split_lines(F.coalesce(F.col(text), F.lit(""))), "\n"))
    parts = F.split(whole, "\n# ", -1)
    each = docs.select("doc_id", F.posexplode(parts).alias("place", "part")).where("place > 0")
    each = each.select("doc_id", "place", T.strip(F.substring_index("part", "\n", 1)).alias("title"), T.strip(F.regexp_replace("part", r"^[^\n]*", "")).alias("body"))
    return each.groupBy("doc_id", "title").agg(F.min("place").alias("place"), F.max_by("body", "place").alias("body"))


def edge_blocks(lines: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, edge, norm): the normalised first and last n non-blank lines of each document."""
    full = F.filter("lines", lambda x: T.strip(x) != "")
    return lines.select("doc_id", F.explode(_edge_structs(full, n)).alias("b")).select("doc_id", "b.*").where("norm <> ''")


def _edge_structs(full: Column, n: int) -> Column:
    """(edge, norm) of the first and last n of a document's non-blank lines; of no lines, both blank."""
    block = lambda part: T.corpus_normalize(F.array_join(part, "\n"))
    first = lambda a: F.struct(F.lit("start").alias("edge"), block(F.slice(a, 1, n)).alias("norm"))
    last = lambda a: F.struct(F.lit("end").alias("edge"), block(F.reverse(F.slice(F.reverse(a), 1, n))).alias("norm"))
    return T.once(full, lambda a: F.array(first(a), last(a)))


def chunks(lines: DataFrame, least: int = 40, most: int = 800) -> DataFrame:
    """(doc_id, ordinal, raw, norm) of the paragraphs."""
    parts = T.paragraphs(F.array_join("lines", "\n"), least, most)
    return lines.select("doc_id", F.posexplode(parts).alias("ordinal", "raw")).withColumn("norm", T.corpus_normalize(F.col("raw")))


def document_threshold(n: int, share: float = 0.02) -> int:
    """Documents that a block must be in: min(n, max(2, ceil(n * share))); 1 for a single document."""
    import math

    return 1 if n <= 1 else min(n, max(2, math.ceil(n * share - 1e-9)))


def frequent_edges(edges: DataFrame, threshold: int) -> DataFrame:
    """(norm) of frequent edge blocks; a document that begins and ends with one counts twice."""
    per = edges.groupBy("edge", "norm").agg(F.count_distinct("doc_id").alias("n"))
    return per.groupBy("norm").agg(F.sum("n").alias("n")).where(F.col("n") >= threshold)


def frequent_chunks(parts: DataFrame, threshold: int) -> DataFrame:
    return parts.groupBy("norm").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= threshold)


def frequent_texts(docs: DataFrame, raw: Column, threshold: int) -> DataFrame:
    """(norm, n) of the chunks, an array ``raw`` of each document, that are in enough documents.

    Documents are counted by the chunks' names. Frequent names are few (all chunks by the threshold); their
    texts are made again from one document each.
    """
    named = lambda d: d.select("doc_id", F.explode(raw).alias("raw")).select("doc_id", T.corpus_normalize(F.col("raw")).alias("norm"))
    names = named(docs).select("doc_id", _name(F.col("norm")).alias("id"))
    found = checkpointed(names.groupBy("id").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id")).where(F.col("n") >= threshold), "frequent")
    held = named(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")).withColumn("id", _name(F.col("norm")))
    return held.join(found.select("id", "n"), "id").groupBy("id").agg(F.first("norm").alias("norm"), F.first("n").alias("n")).select("norm", "n")


def shingles(norm: Column, n: int = 5) -> Column:
    """Distinct word n-grams; of fewer words the words themselves."""

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.array_distinct(F.when(F.size(w) >= n, many).otherwise(w))

    return S.bound(S.tokens(norm), grams)


#: Modulus of the hash family (a prime), and bits of a shingle's own hash: products stay below 2^63.
PRIME, BITS = (1 << 31) - 1, 28


def family(hashes: int) -> list[tuple[int, int]]:
    """(a, b) of each hash function x -> (a x + b) mod PRIME."""
    return [((48271 * (i + 1)) ** 3 % (PRIME - 1) + 1, (69621 * (i + 1)) ** 3 % PRIME) for i in range(hashes)]


def signature(norm: Column, hashes: int, n: int = 5) -> Column:
    """MinHash of a text's shingles: each shingle is hashed once (md5), the seeds are arithmetic; null without shingles.

    An Arrow UDF: the minima are one matrix step for a text, against ``hashes`` interpreted lambdas.
    """

    def least(texts: pd.Series) -> pd.Series:
        a, b = (np.array(x, np.int64)[:, None] for x in zip(*family(hashes), strict=True))
        out = []
        for text in texts:
            w = (text or "").split()
            grams = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else set(w)
            x = np.fromiter((int(hashlib.md5(g.encode()).hexdigest()[: BITS // 4], 16) for g in grams), np.int64, len(grams))
            low = np.full((hashes, 1), PRIME, np.int64)
            for first in range(0, len(x), 1 << 14):
                low = np.minimum(low, ((a * x[first : first + (1 << 14)] + b) % PRIME).min(axis=1, keepdims=True))
            out.append(low[:, 0].tolist() if len(x) else None)
        return pd.Series(out)

    return F.pandas_udf(least, "array<bigint>")(norm)


def _bands(sig: Column, hashes: int, rows: int) -> Column:
    def keys(s: Column) -> Column:
        return F.array(*[F.struct(F.lit(b).alias("band"), F.md5(F.concat_ws("|", F.slice(s, b * rows + 1, rows).cast("array<string>")).cast("binary")).alias("key")) for b in range(hashes // rows)])

    return S.bound(sig, keys)


def lsh_bands(parts: DataFrame, hashes: int = 64, rows: int = 4) -> DataFrame:
    """(norm, band, key): band keys of each distinct chunk; signatures are computed once per distinct text."""
    distinct = widened(parts.select("norm").where("norm <> ''").distinct(), "norm")
    ship(parts.sparkSession)
    signed = distinct.withColumn("sig", signature(F.col("norm"), hashes)).where("sig is not null")
    return signed.select("norm", F.explode(_bands(F.col("sig"), hashes, rows)).alias("b")).select("norm", "b.*")


def _name(norm: Column) -> Column:
    """16 bytes that stand for a normalised text wherever it would be shuffled."""
    return F.unhex(F.md5(norm.cast("binary")))


def hot_chunks(parts: DataFrame, threshold: int, hashes: int = 64, rows: int = 4) -> DataFrame:
    """(norm) of chunks of which a band bucket spans enough documents."""
    named = checkpointed(parts.select("doc_id", "norm", _name(F.col("norm")).alias("id")), "named")
    hot = _hot_names(named.select("doc_id", "id", "norm"), F.col("norm"), threshold, hashes, rows)
    return named.join(hot, "id", "left_semi").select("norm").distinct()


def _hot_names(named: DataFrame, norm: Column, threshold: int, hashes: int, rows: int) -> DataFrame:
    """(id) of the chunks named(doc_id, id, and what ``norm`` is made from) of which a band bucket spans enough documents.

    Texts travel once, to be signed; bands are 8 bytes each (the hash of the band's number and minima). Only
    buckets with enough chunks count their documents: at most ``hashes / rows`` times the chunks by the threshold.
    """
    spark = named.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    holder = next(c for c in named.columns if c not in ("doc_id", "id"))
    texts = named.groupBy("id").agg(F.first(holder).alias(holder)).repartition(n, "id")
    keys = lambda s: F.array(*[F.xxhash64(F.lit(b), *[s[b * rows + i] for i in range(rows)]) for b in range(hashes // rows)])
    signed = texts.select("id", norm.alias("norm")).where("norm <> ''").withColumn("sig", signature(F.col("norm"), hashes))
    signed = checkpointed(signed.where("sig is not null").select("id", keys(F.col("sig")).alias("keys")), "signed")
    held = named.select("id", "doc_id").distinct().join(signed, "id").select("doc_id", F.explode("keys").alias("key"))
    many = checkpointed(held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select("key"), "many")
    wide = held.join(many, "key", "left_semi").groupBy("key").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= threshold).select("key")
    wide = checkpointed(wide, "wide")
    return checkpointed(signed.select("id", F.explode("keys").alias("key")).join(wide, "key", "left_semi").select("id").distinct(), "hot")


def clean_corpus(docs: DataFrame, share: float = 0.02, hashes: int = 64, rows: int = 4, edges: int = 3, least: int = 40, most: int = 800) -> tuple[DataFrame, DataFrame]:
    """(cleaned(doc_id, text), counters): boilerplate edges, frequent chunks and near-duplicate buckets out.

    One pass over the texts writes the chunks of each document; all decisions are made on their names.
    """
    n = docs.count()
    t = document_threshold(n, share)
    lines = clean_lines(docs)
    names = lambda part: F.transform(part, lambda raw: F.struct(raw.alias("raw"), _name(T.corpus_normalize(raw)).alias("id")))
    blocks = F.filter(_edge_structs(F.filter("lines", lambda x: T.strip(x) != ""), edges), lambda b: b["norm"] != "")
    blocks = F.transform(blocks, lambda b: F.struct(b["edge"].alias("edge"), _name(b["norm"]).alias("id")))
    cut = lines.select("doc_id", blocks.alias("blocks"), names(T.paragraphs(F.array_join("lines", "\n"), least, most)).alias("parts"))
    cut = checkpointed(cut, "cut")
    parts = cut.select("doc_id", F.posexplode("parts").alias("ordinal", "part")).select("doc_id", "ordinal", "part.raw", "part.id")
    edge = frequent_edges(cut.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.edge", F.col("b.id").alias("norm")), t)
    edge = checkpointed(edge.select(F.col("norm").alias("id"), F.lit(1).alias("is_edge")), "edges")
    common = frequent_chunks(parts.select("doc_id", F.col("id").alias("norm")), t)
    common = checkpointed(common.select(F.col("norm").alias("id"), F.lit(1).alias("is_common")), "common")
    rest = parts.join(edge, "id", "left_anti").join(common, "id", "left_anti").select("doc_id", "id", "raw")
    hot = _hot_names(rest, T.corpus_normalize(F.col("raw")), t, hashes, rows).withColumn("is_hot", F.lit(1))
    marked = parts.join(edge, "id", "left").join(common, "id", "left").join(hot, "id", "left")
    kept = marked.where("is_edge is null and is_common is null and is_hot is null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))), lambda x: x["raw"]), "\n\n")
    out = kept.groupBy("doc_id").agg(T.light_normalize(body).alias("text"))
    c = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    e, m = F.col("is_edge").isNotNull(), F.col("is_common").isNotNull()
    counters = marked.agg(F.count("*").alias("chunks"), c(e).alias("dropped_edge"), c(~e & m).alias("dropped_frequent"), c(~e & ~m & F.col("is_hot").isNotNull()).alias("dropped_near"), c(~e & ~m & F.col("is_hot").isNull()).alias("kept"))
    return docs.select("doc_id").join(out, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit(""))), counters.withColumn("documents", F.lit(n)).withColumn("threshold", F.lit(t))
