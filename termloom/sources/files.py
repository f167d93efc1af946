"""Readers of terminology releases, pair sources, glossaries, XML and text files.

Every reader has an explicit all-string schema: identifiers are text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.similarity import tokens
from ..operators.pairs import first_by

# Fixed identifiers of the release format.
FSN, SYNONYM, IS_A = "900000000000003001", "900000000000013009", "116680003"
PREFERRED = "900000000000548007"
CONCEPT_COLUMNS = ("id", "effectiveTime", "active", "moduleId", "definitionStatusId")
DESCRIPTION_COLUMNS = ("id", "effectiveTime", "active", "moduleId", "conceptId", "languageCode", "typeId", "term", "caseSignificanceId")
RELATIONSHIP_COLUMNS = ("id", "effectiveTime", "active", "moduleId", "sourceId", "destinationId", "relationshipGroup", "typeId", "characteristicTypeId", "modifierId")
REFSET_COLUMNS = ("id", "effectiveTime", "active", "moduleId", "refsetId", "referencedComponentId", "acceptabilityId")


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Comma-separated with a header and standard quotes; cells may hold line ends."""
    return spark.read.schema(strings(columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], quoted: bool = False) -> DataFrame:
    """Tab-separated with a header; release files have no quoting."""
    reader = spark.read.schema(strings(columns)).option("header", True).option("sep", "\t")
    return (reader if quoted else reader.option("quote", "")).csv(path)


def find_release_file(spark: SparkSession, root: str, pattern: str) -> str:
    """The one file under Snapshot/Terminology that matches; none or several are errors."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/Snapshot/Terminology/{pattern}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    paths = [s.getPath().toString() for s in found]
    if not paths:
        raise FileNotFoundError(f"no file {pattern} in {root}")
    if len(paths) > 1:
        raise ValueError(f"several files {pattern} in {root}: {sorted(paths)}")
    return paths[0]


def release_id(path: str) -> str:
    """<edition>_<date> of a release file's name, else the folder's name."""
    m = re.search(r"_([A-Z]{2,}[A-Z0-9]*_\d{8})\.txt$", path)
    return m[1] if m else path.rstrip("/").rsplit("/", 2)[-2]


def active_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.where("active = '1'").select("id").distinct()


def concept_terms(concepts: DataFrame, descriptions: DataFrame, scope: DataFrame | None = None, language: str = "en") -> DataFrame:
    """(sctid, fsn, synonyms) of active concepts; descriptions carry ``pos``, their place in the file.

    The first full name wins; synonyms are distinct, in order; blank terms and
    other types are ignored, concepts without any text dropped.
    """
    ids = active_concepts(concepts)
    if scope is not None:
        ids = ids.join(scope.select("id").distinct(), "id", "left_semi")
    d = descriptions.where((F.col("active") == "1") & (F.col("languageCode") == language) & F.col("typeId").isin(FSN, SYNONYM))
    d = d.withColumn("term", X.text_or_empty(F.col("term"))).where("term <> ''").select("conceptId", "typeId", "term", "pos")
    d = d.join(ids.withColumnRenamed("id", "conceptId"), "conceptId", "left_semi")
    is_fsn = F.col("typeId") == FSN
    grouped = d.groupBy(F.col("conceptId").alias("sctid")).agg(
        F.min_by(F.when(is_fsn, F.col("term")), F.when(is_fsn, F.col("pos"))).alias("fsn"),
        F.array_sort(F.collect_list(F.when(~is_fsn, F.struct("pos", "term")))).alias("s"),
        F.min("pos").alias("first"),
    )
    synonyms = F.filter(F.array_distinct(F.transform("s", lambda x: x["term"])), lambda t: F.coalesce(t != F.col("fsn"), F.lit(True)))
    return grouped.select("sctid", F.coalesce("fsn", F.lit("")).alias("fsn"), synonyms.alias("synonyms"), "first")


def is_a_edges(relationships: DataFrame) -> DataFrame:
    return relationships.where((F.col("active") == "1") & (F.col("typeId") == IS_A)).select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent"))


def scope_ids(rows: DataFrame) -> DataFrame:
    """(id): the first non-blank of sctid, conceptId and id."""
    have = [c for c in ("sctid", "conceptId", "id") if c in rows.columns]
    if not have:
        raise ValueError("no id column")
    first = F.coalesce(*[F.when(X.text_or_empty(F.col(c)) != "", X.strip(F.col(c))) for c in have])
    return rows.select(first.alias("id")).where("id is not null").distinct()


def preferred_terms(refset: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(conceptId, preferred, acceptables) by a language reference set; concepts without a preferred term are dropped."""
    r = refset.where("active = '1'").select(F.col("referencedComponentId").alias("id"), (F.col("acceptabilityId") == PREFERRED).alias("is_preferred"))
    d = descriptions.where((F.col("active") == "1") & (F.col("typeId") == SYNONYM)).select("id", "conceptId", "term", "pos")
    both = d.join(r, "id")
    terms = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_preferred"), F.struct("pos", "term")))), lambda x: x["term"])
    out = both.groupBy("conceptId").agg(F.min_by(F.when(F.col("is_preferred"), F.col("term")), F.when(F.col("is_preferred"), F.col("pos"))).alias("preferred"), F.array_distinct(terms).alias("acceptables"))
    return out.where("preferred is not null")


def any_term_gold(descriptions: DataFrame) -> DataFrame:
    """(conceptId, term): a synonym if there is one, else the first description."""
    d = descriptions.where("active = '1'")
    return d.groupBy("conceptId").agg(F.min_by("term", F.struct((F.col("typeId") != SYNONYM).cast("int"), "pos")).alias("term"))


def multi_reference_gold(descriptions: DataFrame) -> DataFrame:
    """(conceptId, refs): the set of active terms of each concept, of any type."""
    return descriptions.where("active = '1'").groupBy("conceptId").agg(F.array_sort(F.collect_set("term")).alias("refs"))


def vocabulary_pairs(concepts: DataFrame, synonyms: DataFrame, vocabularies: Sequence[str], language: str) -> DataFrame:
    """(en, target, source): concept names with the synonyms of one language, by vocabulary."""
    names = concepts.where(F.col("vocabulary_id").isin(*vocabularies)).select("concept_id", F.col("concept_name").alias("en"), F.col("vocabulary_id").alias("source"))
    other = synonyms.where(F.col("language_concept_id") == language).select("concept_id", F.col("concept_synonym_name").alias("target"))
    return names.join(other, "concept_id").select("en", "target", "source")


def national_pairs(national: DataFrame, national_en: DataFrame, international: DataFrame) -> DataFrame:
    """(en, target, kind) of a national extension: canonical pairs and all synonym pairs.

    The English name of the international release comes first, the national one
    fills gaps. The canonical target is the full name, else the smallest synonym.
    """
    fsn = lambda d, name: d.where((F.col("active") == "1") & (F.col("typeId") == FSN)).groupBy("conceptId").agg(F.min_by("term", "pos").alias(name))
    syn = lambda d, name: d.where((F.col("active") == "1") & (F.col("typeId") == SYNONYM)).groupBy("conceptId").agg(F.array_sort(F.collect_set("term")).alias(name))
    t = fsn(national, "t_fsn").join(syn(national, "t_syn"), "conceptId", "full")
    e = fsn(international, "i_fsn").join(fsn(national_en, "n_fsn"), "conceptId", "full").join(syn(international, "e_syn"), "conceptId", "full")
    both = t.join(e, "conceptId").withColumn("en", F.coalesce("i_fsn", "n_fsn")).withColumn("target", F.coalesce("t_fsn", F.try_element_at("t_syn", F.lit(1))))
    canonical = both.where("en is not null and target is not null").select("conceptId", "en", "target", F.lit("canonical").alias("kind"))
    other = both.select("conceptId", F.explode("e_syn").alias("en"), "t_syn").select("conceptId", "en", F.explode("t_syn").alias("target"), F.lit("synonym").alias("kind"))
    return canonical.unionByName(other)


def part_pairs(table: DataFrame, linguistic: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """(part, en, target) of a variant table joined by number, its part columns unpivoted."""
    from ..operators.pairs import unpivot_parts

    both = table.select(key, *[F.col(p).alias(f"en_{p}") for p in parts]).join(linguistic.select(key, *[F.col(p).alias(f"t_{p}") for p in parts]), key)
    return unpivot_parts(both, [key], [f"en_{p}" for p in parts], [f"t_{p}" for p in parts])


def read_tmx(spark: SparkSession, path: str, languages: tuple[str, str] = ("en", "et")) -> DataFrame:
    """(en, target) of translation units with both segments, by the XML source."""
    schema = "tuv array<struct<`_xml:lang`: string, `_lang`: string, seg: string>>"
    units = spark.read.format("xml").option("rowTag", "tu").schema(schema).load(path)
    lang = lambda x: F.lower(F.substring(F.coalesce(x["_xml:lang"], x["_lang"]), 1, 2))
    seg = lambda code: F.try_element_at(F.filter("tuv", lambda x: lang(x) == code), F.lit(1))["seg"]
    out = units.select(X.text_or_empty(seg(languages[0])).alias("en"), X.text_or_empty(seg(languages[1])).alias("target"))
    return out.where("en <> '' and target <> ''")


def glossary_lines(lines: DataFrame, split_synonyms: bool = True) -> DataFrame:
    """(en, target) of glossary lines(pos, value): fields by tab or two spaces, Latin first and Hangul last, English at most 120 characters.

    English synonyms are separated by ';'; of equal English terms the first stays.
    """
    fields = F.filter(F.transform(F.split("value", r"\t|\s{2,}"), X.clean_cell), lambda x: x != "")
    rows = lines.withColumn("f", fields).where(F.size("f") >= 2).select("pos", F.col("f")[0].alias("en"), F.element_at("f", -1).alias("target"))
    rows = rows.where(X.has_latin(F.col("en")) & X.has_hangul(F.col("target")) & (F.length("en") <= 120))
    if split_synonyms:
        rows = rows.select("pos", F.posexplode(F.split("en", ";")).alias("i", "en"), "target").withColumn("en", X.strip(F.col("en"))).where("en <> ''")
    else:
        rows = rows.withColumn("i", F.lit(0))
    return first_by(rows, [F.lower("en")], ["pos", "i"]).select("en", "target")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the text files below a folder; blank ones are skipped."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(X.text_or_empty(F.col("value")) != "")


def role_rows(df: DataFrame, roles: dict[str, str], limit: int | None = None, pos: str = "pos") -> DataFrame:
    """Columns renamed to their roles, the first rows by position."""
    out = df.select(pos, *[F.col(c).alias(r) for r, c in roles.items()])
    return out.orderBy(pos).limit(limit) if limit else out


def html_terms(pages: DataFrame, item: str, term: str, definition: str) -> DataFrame:
    """(page_id, pos, term, definition) of glossary pages, by patterns with one group; items without a term are skipped."""
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(item), 1)).alias("pos", "body"))
    bare = lambda p: X.strip(F.regexp_replace(X.html_strip(F.regexp_replace(F.regexp_extract("body", p, 1), r"(?s)<em>.*?</em>", "")), r"\s+", " "))
    return items.select("page_id", "pos", bare(term).alias("term"), bare(definition).alias("definition")).where("term <> ''")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): distinct addresses that a page points to."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"#]+)"'), 1))).alias("link"))


def crawl(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """Urls reachable from starts(url) by links among pages(url, html); each is visited once.

    Goes on until a round finds no new page: what has been seen grows with every round before, so it ends.
    """
    from .tables import checkpointed

    links = checkpointed(pages.select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"#]+)"'), 1))).alias("to")), "links")
    known = checkpointed(links.join(pages.select(F.col("url").alias("to")).distinct(), "to", "left_semi").distinct(), "known-links")
    seen = frontier = checkpointed(starts.select("url").distinct(), "seen")
    while not frontier.isEmpty():
        new = frontier.join(known, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = checkpointed(new, "frontier")
        seen = checkpointed(seen.unionAll(frontier), "seen")
    return seen


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as CSV with a header, white space kept; a resumed run appends."""
    out = df.write.mode("append" if append else "errorifexists").option("header", True).option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def word_total(text: Column) -> Column:
    """Pieces of a text between single spaces."""
    return F.size(F.split(text, " "))


def token_total(text: Column) -> Column:
    return F.size(tokens(text))
