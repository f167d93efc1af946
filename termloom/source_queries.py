"""Registered queries of the readers, writers and keyed tables, over files that are made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import text as T
from .operators import metrics, pairs, retrieval
from .plans import config, flow
from .plans import functions as _registered  # noqa: F401
from .queries import query
from .sources import files as S
from .sources import tables as K
from .sources.positions import positioned
from .sources.walk import Walk


def _folder(spark: SparkSession, name: str) -> str:
    return f"{K.shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, root: str, pattern: str, columns: tuple[str, ...]) -> DataFrame:
    return S.read_tsv(spark, S.find_release_file(spark, root, pattern), columns)


def _descriptions(spark: SparkSession, root: str) -> DataFrame:
    return positioned(_read(spark, root, "sct2_Description_*.txt", S.DESCRIPTION_COLUMNS))


_CONCEPTS = "c AS (SELECT CAST(p_partkey + 1000000 AS VARCHAR) AS id, CAST(p_partkey AS BIGINT) AS k, p_name, p_brand, p_type, p_size, p_size % 10 <> 0 AS active FROM part)"


@query("release_name", f"SELECT '{A.RELEASE}' AS release, CAST(count(*) AS BIGINT) AS n FROM part")
def release_name(spark, sf_dir):
    path = S.find_release_file(spark, A.release(spark, sf_dir), "sct2_Concept_*.txt")
    return S.read_tsv(spark, path, S.CONCEPT_COLUMNS).agg(F.lit(S.release_id(path)).alias("release"), F.count("*").alias("n"))


@query("release_active_concepts", f"WITH {_CONCEPTS} SELECT id FROM c WHERE active")
def release_active_concepts(spark, sf_dir):
    return S.active_concepts(_read(spark, A.release(spark, sf_dir), "sct2_Concept_*.txt", S.CONCEPT_COLUMNS))


@query("release_concept_terms", f"""WITH {_CONCEPTS} SELECT id AS sctid, p_name || ' (' || p_type || ')' AS fsn, array_to_string(list_distinct_ordered, '|') AS synonyms, k * 5 AS first FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN [p_name, p_type || ' "quoted"'] ELSE [p_name, p_brand, p_type || ' "quoted"'] END AS list_distinct_ordered FROM c WHERE active)""")
def release_concept_terms(spark, sf_dir):
    root = A.release(spark, sf_dir)
    out = S.concept_terms(_read(spark, root, "sct2_Concept_*.txt", S.CONCEPT_COLUMNS), _descriptions(spark, root))
    return out.select("sctid", "fsn", F.array_join("synonyms", "|").alias("synonyms"), "first")


@query("release_concept_terms_in_scope", f"WITH {_CONCEPTS} SELECT id AS sctid, p_name || ' (' || p_type || ')' AS fsn FROM c WHERE active AND p_size < 20")
def release_concept_terms_in_scope(spark, sf_dir):
    """The scope is a CSV file of ids in one of several columns."""
    root, where = A.release(spark, sf_dir), _folder(spark, "scope")
    p = A.table(spark, sf_dir, "part")
    one = F.when(F.col("p_size") % 2 == 0, (F.col("p_partkey") + 1000000).cast("string"))
    S.write_csv(p.where("p_size < 20").select(F.coalesce(one, F.lit(" ")).alias("sctid"), (F.col("p_partkey") + 1000000).cast("string").alias("conceptId")), where)
    scope = S.scope_ids(S.read_csv(spark, where, ("sctid", "conceptId")))
    return S.concept_terms(_read(spark, root, "sct2_Concept_*.txt", S.CONCEPT_COLUMNS), _descriptions(spark, root), scope).select("sctid", "fsn")


@query("scope_ids", "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'a' || p_size ELSE 'b' || p_brand END AS id FROM part")
def scope_ids(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return S.scope_ids(p.select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" a"), F.col("p_size").cast("string"))).alias("sctid"), F.lit(" ").alias("conceptId"), F.concat(F.lit("b"), "p_brand").alias("id")))


@query("release_is_a", f"WITH {_CONCEPTS} SELECT id AS child, CAST(k % 50 + 1000000 AS VARCHAR) AS parent FROM c WHERE active AND k % 3 <> 0")
def release_is_a(spark, sf_dir):
    return S.is_a_edges(_read(spark, A.release(spark, sf_dir), "sct2_Relationship_*.txt", S.RELATIONSHIP_COLUMNS))


@query("release_preferred_terms", f"""WITH {_CONCEPTS} SELECT id AS "conceptId", CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type || ' "quoted" ' END AS preferred, CASE WHEN p_size % 3 = 0 THEN p_type || ' "quoted" ' ELSE p_name END AS acceptables FROM c WHERE active AND p_size % 3 < 2""")
def release_preferred_terms(spark, sf_dir):
    root = A.release(spark, sf_dir)
    refset = _read(spark, root, "der2_cRefset_Language*.txt", S.REFSET_COLUMNS)
    return S.preferred_terms(refset, _descriptions(spark, root)).select("conceptId", "preferred", F.array_join("acceptables", "|").alias("acceptables"))


@query("release_any_term", f"""WITH {_CONCEPTS} SELECT id AS "conceptId", p_name AS term FROM c""")
def release_any_term(spark, sf_dir):
    return S.any_term_gold(_descriptions(spark, A.release(spark, sf_dir)))


@query("release_multi_reference", f"""WITH {_CONCEPTS} SELECT id AS "conceptId", array_to_string(list_sort(list_distinct([p_name || ' (' || p_type || ')', p_name, p_type || ' "quoted" ', 'õ ' || p_brand] || CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_brand] END)), '|') AS refs FROM c""")
def release_multi_reference(spark, sf_dir):
    return S.multi_reference_gold(_descriptions(spark, A.release(spark, sf_dir))).select("conceptId", F.array_join("refs", "|").alias("refs"))


@query("national_pairs", """WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS c, CASE WHEN p_size % 5 <> 0 THEN 'I ' || p_name END AS i_fsn, 'N ' || p_name AS n_fsn, CASE WHEN p_size % 2 = 0 THEN 'T ' || p_brand END AS t_fsn, list_distinct(['S ' || p_type, 'S ' || p_brand]) AS t_syn, list_distinct([p_name, p_type]) AS e_syn FROM part)
SELECT c AS "conceptId", coalesce(i_fsn, n_fsn) AS en, coalesce(t_fsn, list_min(t_syn)) AS target, 'canonical' AS kind FROM d UNION ALL SELECT c, e, unnest(t_syn), 'synonym' FROM (SELECT c, t_syn, unnest(e_syn) AS e FROM d)""")
def national_pairs(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("conceptId"), "p_name", "p_brand", "p_type", "p_size")
    made = lambda df, kind, term: df.select("conceptId", F.lit("1").alias("active"), F.lit(kind).alias("typeId"), term.alias("term"), F.lit(1).alias("pos"))
    named = lambda x, c: F.concat(F.lit(x), c)
    international = made(p.where("p_size % 5 <> 0"), S.FSN, named("I ", "p_name")).unionAll(made(p, S.SYNONYM, F.col("p_name"))).unionAll(made(p, S.SYNONYM, F.col("p_type")))
    national = made(p.where("p_size % 2 = 0"), S.FSN, named("T ", "p_brand")).unionAll(made(p, S.SYNONYM, named("S ", "p_type"))).unionAll(made(p, S.SYNONYM, named("S ", "p_brand")))
    return S.national_pairs(national, made(p, S.FSN, named("N ", "p_name")), international)


@query("part_pairs", "SELECT p_partkey, 0 AS part, 'e' || p_name AS en, 't' || p_name AS target FROM part UNION ALL SELECT p_partkey, 1, 'e' || p_type, 't' || p_type FROM part WHERE p_size % 2 = 0")
def part_pairs(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    side = lambda x, blank: p.select("p_partkey", F.concat(F.lit(x), "p_name").alias("a"), F.when((F.col("p_size") % 2 == 0) | F.lit(not blank), F.concat(F.lit(x), "p_type")).alias("b"))
    return S.part_pairs(side("e", False), side("t", True), "p_partkey", ["a", "b"])


@query("tmx_pairs", "SELECT p_name || ' & <' || p_partkey || '>' AS en, 'ä ' || p_brand AS target FROM part WHERE p_size % 4 <> 0")
def tmx_pairs(spark, sf_dir):
    """Translation units written as XML and read back; units without a second segment are left out."""
    where = _folder(spark, "tmx")
    p = A.table(spark, sf_dir, "part")
    unit = F.array(F.struct(F.lit("en-GB").alias("_lang"), F.concat("p_name", F.lit(" & <"), F.col("p_partkey").cast("string"), F.lit(">")).alias("seg")), F.struct(F.when(F.col("p_size") % 4 == 0, "de").otherwise("ET").alias("_lang"), F.concat(F.lit("ä "), "p_brand").alias("seg")))
    p.select(unit.alias("tuv")).write.format("xml").option("rootTag", "body").option("rowTag", "tu").save(where)
    return S.read_tmx(spark, where)


_GLOSSARY = "l AS (SELECT p_partkey AS pos, p_name, p_type, p_size FROM part WHERE p_size % 6 <> 0), e AS (SELECT pos, 0 AS i, p_name AS en, p_type FROM l UNION ALL SELECT pos, 1, p_type, p_type FROM l WHERE p_size % 5 <> 0), r AS (SELECT en, '가 ' || p_type AS target, row_number() OVER (PARTITION BY lower(en) ORDER BY pos, i) AS k FROM e)"


@query("glossary_lines", f"WITH {_GLOSSARY} SELECT en, target FROM r WHERE k = 1")
def glossary_lines(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    en = F.concat("p_name", F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("; "), "p_type")).otherwise(F.lit(" ;")))
    line = F.concat(en, F.when(F.col("p_size") % 2 == 0, "\t").otherwise("   "), F.when(F.col("p_size") % 6 == 0, "no target").otherwise(F.concat(F.lit("가  "), "p_type", F.lit(" 12"))))
    # Two spaces inside a field end it, so the target's own are written as one.
    return S.glossary_lines(p.select(F.col("p_partkey").alias("pos"), F.regexp_replace(line, "가  ", "가 ").alias("value")))


@query("tab_glossary", """WITH l AS (SELECT p_partkey AS pos, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || '; ' || p_type END AS en, p_type FROM part WHERE p_size % 6 <> 0), r AS (SELECT en, '가 ' || p_type AS target, row_number() OVER (PARTITION BY lower(en) ORDER BY pos) AS k FROM l) SELECT en, target FROM r WHERE k = 1""")
def tab_glossary(spark, sf_dir):
    """Lines of two fields by tab, read from a file in its order; English synonyms stay together."""
    where = _folder(spark, "glossary")
    p = A.table(spark, sf_dir, "part")
    en = F.concat("p_name", F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("; "), "p_type")).otherwise(F.lit("")))
    line = F.concat(en, F.lit("\t"), F.when(F.col("p_size") % 6 == 0, "no target").otherwise(F.concat(F.lit("가 "), "p_type", F.lit(" 12"))))
    p.orderBy("p_partkey").select(line.alias("value")).write.text(where)
    return S.glossary_lines(positioned(spark.read.schema("value string").text(where)), split_synonyms=False)


@query("file_positions", "SELECT CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) - 1 AS pos FROM part")
def file_positions(spark, sf_dir):
    """Rows written in shuffled order to several files, and their places when they are read."""
    where = _folder(spark, "shuffled")
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    S.write_csv(p.orderBy(F.md5(F.col("id").cast("binary")), F.col("id").cast("long")), where)
    return positioned(S.read_csv(spark, where, ("id",)))


_FILE_ORDER = """WITH r AS (SELECT 'c' || p_partkey % 500 AS sctid, p_name AS ref, row_number() OVER (ORDER BY md5('r' || p_partkey), p_partkey) AS pos FROM part), t AS (SELECT 'c' || p_partkey % 700 AS sctid, p_name AS cand, row_number() OVER (ORDER BY md5('t' || p_partkey), p_partkey) AS pos FROM part),
f AS (SELECT sctid, min(pos) AS first, max_by(ref, pos) AS ref FROM r GROUP BY sctid), g AS (SELECT sctid, max_by(cand, pos) AS cand FROM t GROUP BY sctid)"""


@query("flow_file_order", f"{_FILE_ORDER} SELECT sctid, cand AS candidate, ref AS best_ref, CAST(replace(cand, ' ', '') = replace(ref, ' ', '') AS INT) AS exact FROM f JOIN g USING (sctid) ORDER BY first LIMIT 100")
def flow_file_order(spark, sf_dir):
    """A flow over files of shuffled, repeated keys: the last row of a key wins, the first hundred keys of the reference count."""
    spec = {}
    for name, keys, column in (("r", 500, "target"), ("t", 700, "target")):
        spec[name] = {"kind": "csv", "path": _folder(spark, f"flow-{name}")}
        p = A.table(spark, sf_dir, "part").orderBy(F.md5(F.concat(F.lit(name), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey")
        S.write_csv(p.select(F.concat(F.lit("c"), (F.col("p_partkey") % keys).cast("string")).alias("sctid"), F.lit("x").alias("en"), F.col("p_name").alias(column)), spec[name]["path"])
    nodes = [{"id": n, "type": "datasource", "params": {"source": n}} for n in spec]
    nodes += [{"id": "e", "type": "evaluate", "params": {"limit": 100}, "inputs": {"translations": "t", "reference": "r"}}]
    built, context = config.assemble(spark, {"nodes": nodes}, {"sources": spec}, {})
    done = flow.run(built, context)["e"]
    if not done.ok:
        raise RuntimeError(done.error)
    return done.outputs["rows"].select("sctid", "candidate", "best_ref", "exact")


@query("cell_cleaning", "SELECT p_partkey, p_name || ' x ' || p_type || ' end' AS cell, p_name || ' ' || p_type || '!' AS bare FROM part")
def cell_cleaning(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    cell = F.concat(F.lit("  "), "p_name", F.lit("\t x \n"), "p_type", F.lit(" end 12"))
    return p.select("p_partkey", T.clean_cell(cell).alias("cell"), T.strip_parens(F.concat(F.lit("("), "p_name", F.lit(") "), "p_type", F.lit("(!)"))).alias("bare"))


_CRAWL = "n AS (SELECT count(*) AS n FROM pages), l AS (SELECT CAST(page_id AS BIGINT) AS a, CAST((page_id * 2 + 1) % n.n AS BIGINT) AS b FROM pages, n UNION ALL SELECT CAST(page_id AS BIGINT), CAST(page_id + 7 AS BIGINT) FROM pages, n)"


@query("page_crawl", f"WITH RECURSIVE {_CRAWL}, r AS (SELECT 3::BIGINT AS p UNION SELECT b FROM r JOIN l ON l.a = r.p JOIN pages ON pages.page_id = l.b) SELECT 'u' || p AS url FROM r")
def page_crawl(spark, sf_dir):
    """Links are added to the raw pages, so that they lead from one to another."""
    pages = A.table(spark, sf_dir, "pages")
    n = pages.count()
    link = lambda x: F.concat(F.lit('<a class="x" href="u'), x.cast("string"), F.lit('">go</a>'))
    made = pages.select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.concat("html", link((F.col("page_id") * 2 + 1) % n), link(F.col("page_id") + 7)).alias("html"))
    return S.crawl(made, spark.createDataFrame([("u3",)], "url string"))


@query("page_walk", f"WITH RECURSIVE {_CRAWL}, r AS (SELECT 3::BIGINT AS p UNION SELECT b FROM r JOIN l ON l.a = r.p JOIN pages ON pages.page_id = l.b) SELECT 'u' || p AS url, CASE WHEN p % 3 = 0 THEN 2 ELSE 1 END AS tries FROM r")
def page_walk(spark, sf_dir):
    """The same pages by a walk that fetches them, where every third fails at first."""
    pages = A.table(spark, sf_dir, "pages")
    n = pages.count()
    stored = pages.select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), "page_id")
    link = lambda x: F.concat(F.lit('<a class="x" href="u'), x.cast("string"), F.lit('">go</a>'))
    html = F.concat(F.lit("<p>"), link((F.col("page_id") * 2 + 1) % n), link(F.col("page_id") + 7))

    def fetch(frontier):
        ok = F.col("page_id").isNotNull() & ((F.col("page_id") % 3 != 0) | (F.col("tries") > 0))
        return frontier.join(stored, "url", "left").select("url", F.when(ok, html).alias("html"), F.when(~ok, "no page").alias("error"), "tries")

    walk = Walk(spark, _folder(spark, "walk"), retries=2)
    walk.run(spark.range(1).select(F.lit("u3").alias("url")), fetch)
    return walk.pages().select("url", "tries")


@query("text_files", "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(count(*) FILTER (WHERE trim(text) <> '') > 0 AS BOOLEAN) AS some FROM benchmark")
def text_files(spark, sf_dir):
    where = _folder(spark, "texts")
    b = A.table(spark, sf_dir, "benchmark")
    b.select("text").repartition(4).write.text(where)
    t = S.read_texts(spark, where)
    return t.agg(F.sum(F.length("text")).alias("chars"), F.expr("bool_and(path like '%.txt')").alias("some"))


@query("reference_loader", "SELECT p_partkey, array_to_string(CASE WHEN p_size % 3 = 0 THEN [p_name, p_type] WHEN p_size % 3 = 1 THEN [p_brand] ELSE [''] END, '/') AS refs FROM part")
def reference_loader(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    many = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" | | "), "p_type", F.lit("|"))).when(F.col("p_size") % 3 == 1, " | ")
    one = F.when(F.col("p_size") % 3 < 2, F.col("p_brand"))
    return p.select("p_partkey", F.array_join(metrics.split_references(one, many), "/").alias("refs"))


@query("score_rows", "WITH r AS (SELECT CAST(p_partkey % 100 AS BIGINT) AS k, max(p_partkey) AS p FROM part GROUP BY 1) SELECT k AS sctid, p_name AS candidate, p_name AS best_ref, 1 AS exact, 100.0::DOUBLE AS chrf FROM r JOIN part ON p_partkey = p")
def score_rows(spark, sf_dir):
    """Keys that repeat: the last candidate against the last references, one of which is the same text."""
    p = A.table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).cast("long").alias("sctid"), F.col("p_partkey").alias("pos"), "p_name", "p_type")
    return metrics.score_rows(p.select("sctid", "pos", F.col("p_name").alias("candidate")), p.select("sctid", "pos", F.array("p_type", "p_name").alias("refs")))


@query("csv_round_trip", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', "' || p_brand || '"' || chr(10) || p_type AS text FROM part""")
def csv_round_trip(spark, sf_dir):
    """Cells with commas, quotes and line ends, in two appended runs."""
    where = _folder(spark, "csv")
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("text"))
    S.write_csv(p.where("id < '5'"), where)
    S.write_csv(p.where("id >= '5'"), where, append=True)
    return S.read_csv(spark, where, ("id", "text"))


@query("resume_by_count", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') // 4")
def resume_by_count(spark, sf_dir):
    done = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").count() // 4
    return K.resume_by_count(A.table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("content_names", "WITH g AS (SELECT p_size, list_sort(list(DISTINCT p_type)) AS c FROM part GROUP BY p_size) SELECT p_size, min(p_size) OVER (PARTITION BY c) AS twin, 8 AS width FROM g")
def content_names(spark, sf_dir):
    """Groups of parts named by their content: the smallest group that has the same name, and the name's width."""
    rows = A.table(spark, sf_dir, "part").select("p_size", "p_type").distinct()
    named = K.content_groups(rows.repartition(5, F.rand(1)), "p_size")
    twin = named.groupBy("name").agg(F.min("p_size").alias("twin"))
    return named.join(twin, "name").select("p_size", "twin", F.length("name").alias("width"))


@query("drop_stale_tables", "SELECT 'index_' || r_regionkey AS name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = (SELECT max(r_regionkey) FROM region) GROUP BY 1 UNION ALL SELECT 'other', count(*) FROM nation")
def drop_stale_tables(spark, sf_dir):
    """One table a region; all but the last one's are stale. What is left, with the rows of each."""
    prefix, where = f"tl_{uuid.uuid4().hex[:8]}_", _folder(spark, "stale")
    n = A.table(spark, sf_dir, "nation")
    keys = sorted(r["r_regionkey"] for r in A.table(spark, sf_dir, "region").select("r_regionkey").collect())  # a row a region
    for k in keys:
        n.where(F.col("n_regionkey") == k).write.option("path", f"{where}/{k}").saveAsTable(f"{prefix}index_{k}")
    n.write.option("path", f"{where}/other").saveAsTable(f"{prefix}other")
    K.drop_stale(spark, f"{prefix}index_", f"{prefix}index_{keys[-1]}")
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefix)]
    rows = [(x.removeprefix(prefix), spark.table(x).count()) for x in left]
    K.drop_stale(spark, prefix, "")
    return spark.createDataFrame(rows, "name string, n long")


@query("collection_status", "WITH n AS (SELECT (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM part WHERE trim(p_name) <> '' AND p_size < 10) AS f) SELECT 'full' AS name, 'ready' AS status FROM n UNION ALL SELECT 'filled', CASE WHEN f >= p THEN 'ready' ELSE 'partial' END FROM n UNION ALL SELECT 'empty', 'no_pairs' UNION ALL SELECT 'absent', 'missing' UNION ALL SELECT 'unbuilt', 'not_built'")
def collection_status(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    n, filled = p.count(), p.where("trim(p_name) <> '' and p_size < 10").count()
    cases = {"full": (n, n), "filled": (n, filled), "empty": (0, 0), "absent": (n, None), "unbuilt": (None, None)}
    return spark.createDataFrame([(k, K.status(*v)) for k, v in cases.items()], "name string, status string")


@query("publish_and_lineage", "SELECT 'guides' AS kind, 'third' AS name, 'third/second/first' AS lineage, 1::BIGINT AS n, true AS kept UNION ALL SELECT 'datasets', 'pairs', 'pairs', (SELECT count(*) FROM part WHERE p_size > 10), true")
def publish_and_lineage(spark, sf_dir):
    """A dataset and guides with their parents; an entry is replaced only when asked for."""
    made = K.Registry(spark, _folder(spark, "registry"))
    p = A.table(spark, sf_dir, "part")
    made.publish("datasets", "pairs", p, {"source": "part"})
    made.publish("datasets", "pairs", p.where("p_size > 10"), replace=True)
    text = spark.createDataFrame([("# Guide",)], "text string")
    parent = None
    for name in ("first", "second", "third"):
        made.publish("guides", name, text, {"parent": parent} if parent else None)
        parent = name
    try:
        made.publish("guides", "third", text)
        kept = False
    except FileExistsError:
        kept = True
    rows = [("guides", "third", "/".join(made.lineage("guides", "third")), made.read("guides", "third").count(), kept), ("datasets", "pairs", "/".join(made.lineage("datasets", "pairs")), made.read("datasets", "pairs").count(), kept)]
    return spark.createDataFrame(rows, "kind string, name string, lineage string, n long, kept boolean")


@query("cached_lookup", "SELECT p_partkey, CASE WHEN p_size < 25 THEN 'cached ' || p_brand ELSE upper(p_name) END AS value FROM part WHERE p_size > 5")
def cached_lookup(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    cache = p.where("p_size < 25").select("p_partkey", F.concat(F.lit("cached "), "p_brand").alias("value"))
    return K.cached_lookup(p.where("p_size > 5").select("p_partkey", "p_name"), cache, "p_partkey", lambda d: d.select("p_partkey", F.upper("p_name").alias("value")))


@query("pool_and_dedupe_sources", "WITH u AS (SELECT p_partkey AS pos, p_name AS en, p_brand AS target, 'b' AS source FROM part UNION ALL SELECT p_partkey, upper(p_name), p_brand, 'a' FROM part WHERE p_size > 25), r AS (SELECT *, row_number() OVER (PARTITION BY lower(en), target ORDER BY source, pos) AS k FROM u) SELECT pos, en, target, source FROM r WHERE k = 1")
def pool_and_dedupe_sources(spark, sf_dir):
    p = A.pairs(spark, sf_dir).select("pos", "en", "target", F.lit("b").alias("source"))
    q = A.table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("pos"), F.upper("p_name").alias("en"), F.col("p_brand").alias("target"), F.lit("a").alias("source"))
    return pairs.pool_sources(p.unionByName(q), ["a", "b"])


@query("dictionary_index_rows", "SELECT CAST(pos AS BIGINT) AS id, lang, text, translation, definition FROM (SELECT 2 * p_partkey - 1 AS pos, 'et' AS lang, p_brand AS text, p_name AS translation, p_type AS definition FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT 2 * p_partkey, 'en', p_name, p_brand, p_type FROM part WHERE p_size % 3 <> 0)")
def dictionary_index_rows(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    entries = p.select(F.col("p_partkey").cast("long").alias("pos"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).otherwise(" ").alias("term"), F.col("p_name").alias("en"), F.col("p_type").alias("desc"))
    return retrieval.dictionary_rows(entries)
