"""Analogue tables: the domain's inputs, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, en, target, source): bilingual pairs; part names are shared by many rows."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("en"), F.col("p_brand").alias("target"), F.col("p_type").alias("source"))


def fsn_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sctid, pos, kind, surface, tag): a tagged full name for each part."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("sctid"), F.col("p_partkey").alias("pos"), F.lit(0).alias("kind"), F.col("p_name").alias("surface"), F.col("p_type").alias("tag"))


def is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): region <- nation <- supplier and customer, with prefixed ids."""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    edge = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("child"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("parent"))
    return edge(n, "n", "n_nationkey", "r", "n_regionkey").unionAll(edge(s, "s", "s_suppkey", "n", "s_nationkey")).unionAll(edge(c, "c", "c_custkey", "n", "c_nationkey"))


def dense_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def dense_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("gold"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, text): repeated answers per concept, with an error kind among them."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR: "), F.col("event_id").cast("string"))).otherwise(F.when(F.col("event_id") % 2 == 0, F.concat(F.substring("event_type", 1, 2), F.lit(" "), F.substring("event_type", 3, 20))).otherwise(F.col("event_type")))
    return e.select("user_id", F.col("event_id").alias("pos"), text.alias("text"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, quality, toxic, lang): labelled documents and a score."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    return l.join(d.select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", F.round(F.log10(F.col("n_chars") + 1.0), 6).alias("score"), "quality", "toxic", "lang")


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): each document between a title, a section of references, a contact header and a common end."""
    d = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    ends = "\n## References\nsee the list\nCONTACT US\nask the office\n\n# End\ncommon line at the end of all documents\nclosing line number "
    return d.select("doc_id", F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n"), body, F.lit(ends), F.col("doc_id").cast("string")).alias("text"))


CORPUS_SQL = r"cd AS (SELECT doc_id, '# ' || coalesce(source, 'none') || chr(10) || coalesce(text, '') || replace('|## References|see the list|CONTACT US|ask the office||# End|common line at the end of all documents|closing line number ', '|', chr(10)) || doc_id AS text FROM documents)"

RELEASE = "XX1000124_20240131"


def release(spark: SparkSession, sf_dir: str) -> str:
    """A release in files, written to the shared folder: concepts, descriptions in two languages, relationships and a language set of the parts."""
    import uuid

    from .sources import files as S
    from .sources.tables import shared_dir

    root = f"{shared_dir(spark)}/termloom/release-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("long"))
    key = lambda n: (F.col("k") * 10 + n).cast("string")
    text = lambda x: F.lit(x)
    concept = (F.col("k") + 1000000).cast("string")
    on = F.when(F.col("p_size") % 10 == 0, "0").otherwise("1")
    concepts = p.select(concept.alias("id"), text("20240131").alias("effectiveTime"), on.alias("active"), text("1").alias("moduleId"), text("1").alias("definitionStatusId"))
    row = lambda n, active, lang, kind, term: F.struct(key(n).alias("id"), text("20240131").alias("effectiveTime"), active.alias("active"), text("1").alias("moduleId"), concept.alias("conceptId"), text(lang).alias("languageCode"), text(kind).alias("typeId"), term.alias("term"), text("1").alias("caseSignificanceId"))
    lit1 = text("1")
    each = F.array(
        row(1, lit1, "en", S.FSN, F.concat("p_name", text(" ("), "p_type", text(")"))),
        row(2, lit1, "en", S.SYNONYM, F.col("p_name")),
        row(3, F.when(F.col("p_size") % 7 == 0, "0").otherwise("1"), "en", S.SYNONYM, F.col("p_brand")),
        row(4, lit1, "en", S.SYNONYM, F.concat("p_type", text(' "quoted" '))),
        row(5, lit1, "et", S.SYNONYM, F.concat(text("õ "), "p_brand")),
    )
    descriptions = p.select(F.explode(each).alias("d")).select("d.*")
    relationships = p.select(key(6).alias("id"), text("20240131").alias("effectiveTime"), on.alias("active"), text("1").alias("moduleId"), concept.alias("sourceId"), (F.col("k") % 50 + 1000000).cast("string").alias("destinationId"), text("0").alias("relationshipGroup"), F.when(F.col("k") % 3 == 0, "7").otherwise(S.IS_A).alias("typeId"), text("1").alias("characteristicTypeId"), text("1").alias("modifierId"))
    member = F.explode(F.array(F.struct(key(2).alias("d"), F.when(F.col("p_size") % 3 == 0, S.PREFERRED).otherwise("2").alias("a")), F.struct(key(4).alias("d"), F.when(F.col("p_size") % 3 == 1, S.PREFERRED).otherwise("2").alias("a"))))
    refset = p.select("*", member.alias("m")).select(F.col("m.d").alias("id"), text("20240131").alias("effectiveTime"), on.alias("active"), text("1").alias("moduleId"), text("9").alias("refsetId"), F.col("m.d").alias("referencedComponentId"), F.col("m.a").alias("acceptabilityId"))
    for df, name in ((concepts, "sct2_Concept_Snapshot"), (descriptions, "sct2_Description_Snapshot-en"), (relationships, "sct2_Relationship_Snapshot"), (refset, "der2_cRefset_LanguageSnapshot-en")):
        df.write.option("sep", "\t").option("header", True).option("quote", "").option("ignoreTrailingWhiteSpace", False).csv(f"{root}/Snapshot/Terminology/{name}_{RELEASE}.txt")
    return root
