"""Corpus pipeline: language id, near-duplicate removal, repeated-passage removal, mixing, encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame over what its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm import _common as c
from termloom.llm.bpe_codec import encode_documents
from termloom.llm.jaccard_join import jaccard_components
from termloom.llm.language_id import kept_languages
from termloom.llm.mixing import mixed_documents
from termloom.llm.substring_dedup import without_repeats

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough; null texts and texts without letters go."""
    return kept_languages(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id (null comes last).

    Rows with one doc_id and different texts are different documents; rows that are
    alike in both are one, of which one row stays.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    ids = keyed.select("_key", "doc_id").distinct()
    found = jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text"))
    member = found.select(F.col("doc_id").alias("_key"), "component_id").join(ids, "_key")
    member = c.materialize(member, "members")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_key").alias("c"))).alias("first"))
    first = c.materialize(first, "firsts")  # written, so that the members of one large component can be split in the join
    gone = member.join(first, "component_id").where(F.col("_key") != F.col("first.c")).select("_key").distinct()
    alike = Window.partitionBy("_key", "doc_id", "text").orderBy(F.lit(0))
    kept = keyed.join(gone, "_key", "left_anti").withColumn("_row", F.row_number().over(alike)).where(F.col("_row") == 1)
    return kept.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that also stand elsewhere; emptied documents go."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, a document as often as the mix takes it."""
    return mixed_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mix took."""
    return encode_documents(docs, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("language id", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("suffix-array dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
