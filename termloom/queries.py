"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as A
from .functions import replies as R
from .functions import rules as H
from .functions import similarity as S
from .functions import text as T
from .operators import axes, corpus, graph, metrics, pairs, reachability, reports, retrieval, sampling, sparse_index, vector_index
from .operators.order import widened
from .sources import files as SRC
from .sources.tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- retrieval
_UNIT = "vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), hit AS (SELECT q.vec_id AS query_id, q.label AS gold, c.vec_id AS point_id, c.label, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM vec q JOIN vec c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM hit)"


def _top(spark, sf_dir: str, k: int) -> DataFrame:
    corpus_, q = A.dense_corpus(spark, sf_dir), A.dense_queries(spark, sf_dir)
    hits = retrieval.dense_topk(corpus_, q, k)
    return hits.join(corpus_.select("point_id", "label"), "point_id").join(q.select("query_id", "gold"), "query_id")


@query("dense_recall_by_label", f"WITH {_UNIT}, per AS (SELECT query_id, any_value(gold) AS label, coalesce(min(CASE WHEN label = gold THEN rank END), 0) AS correct_rank FROM rk WHERE rank <= 25 GROUP BY query_id) SELECT label, count(*) AS n_queries, round(100.0 * sum(CASE WHEN correct_rank BETWEEN 1 AND 1 THEN 1 ELSE 0 END) / count(*), 4) AS recall_at_1, round(100.0 * sum(CASE WHEN correct_rank BETWEEN 1 AND 3 THEN 1 ELSE 0 END) / count(*), 4) AS recall_at_3, round(100.0 * sum(CASE WHEN correct_rank BETWEEN 1 AND 5 THEN 1 ELSE 0 END) / count(*), 4) AS recall_at_5, round(100.0 * sum(CASE WHEN correct_rank BETWEEN 1 AND 10 THEN 1 ELSE 0 END) / count(*), 4) AS recall_at_10, round(sum(CASE WHEN correct_rank > 0 THEN 1.0::DOUBLE / correct_rank ELSE 0 END) / count(*), 4) AS mrr FROM per GROUP BY label")
def dense_recall_by_label(spark, sf_dir):
    hits = _top(spark, sf_dir, 25)
    ranks = hits.groupBy("query_id").agg(F.first("gold").alias("label"), F.coalesce(F.min(F.when(F.col("label") == F.col("gold"), F.col("rank"))), F.lit(0)).alias("correct_rank"))
    return metrics.recall_metrics(ranks, by=["label"])


@query("dense_topk", f"WITH {_UNIT} SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(A.dense_corpus(spark, sf_dir), A.dense_queries(spark, sf_dir), 10)


_COLLAPSE = f"{_UNIT}, co AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, rank) AS r FROM rk WHERE rank <= 40), cc AS (SELECT query_id, gold, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM co WHERE r = 1)"


@query("collapse_to_concept", f"WITH {_COLLAPSE} SELECT query_id, label, score, CAST(rank AS INT) AS rank FROM cc WHERE rank <= 5")
def collapse_to_concept(spark, sf_dir):
    return retrieval.collapse(_top(spark, sf_dir, 40), "label", 5).select("query_id", "label", "score", "rank")


@query("retrieve_signal", f"WITH {_COLLAPSE}, l AS (SELECT query_id, any_value(gold) AS gold, list(label ORDER BY rank) AS c, list(score ORDER BY rank) AS s FROM cc WHERE rank <= 10 GROUP BY query_id) SELECT query_id, CAST(gold AS VARCHAR) AS gold, CAST(c[1] AS VARCHAR) AS top_concept, round_even(s[1], 4) AS top_score, round_even(coalesce(s[2], 0), 4) AS second_score, round_even(s[1] - coalesce(s[2], 0), 4) AS margin, array_to_string(c[1:10], '|') AS candidates, CAST(coalesce(list_position(c, gold), 0) AS INT) AS correct_rank, round_even(s[list_position(c, gold)], 4) AS correct_score, CASE WHEN c[1] = gold THEN 1 ELSE 0 END AS recovered FROM l")
def retrieve_signal(spark, sf_dir):
    hits = retrieval.collapse(_top(spark, sf_dir, 40), "label", 10)
    return retrieval.retrieve_signal(A.dense_queries(spark, sf_dir).select("query_id", F.col("gold").cast("string").alias("gold")), hits, "label")


_TOK = r"tok AS (SELECT id, token, count(*) AS weight FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS token FROM documents) GROUP BY 1, 2), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, token) AS r FROM tok) WHERE r <= 512), btok AS (SELECT id, token, count(*) AS weight FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS token FROM benchmark) GROUP BY 1, 2), bkept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, token) AS r FROM btok) WHERE r <= 512), sp AS (SELECT q.id AS query_id, p.id AS point_id, CAST(sum(q.weight * p.weight) AS DOUBLE) AS score FROM bkept q JOIN kept p USING (token) GROUP BY 1, 2), srk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sp)"


@query("sparse_topk", f"WITH {_TOK} SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM srk WHERE rank <= 10")
def sparse_topk(spark, sf_dir):
    p = retrieval.lexical_vectors(A.table(spark, sf_dir, "documents"), "doc_id", "text")
    q = retrieval.lexical_weights(A.table(spark, sf_dir, "benchmark"), "item_id", "text")
    return retrieval.sparse_topk(p, q, 10)


@query("sparse_index_topk", f"WITH {_TOK} SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM srk WHERE rank <= 10")
def sparse_index_topk(spark, sf_dir):
    """The same ranking from an index that is written by block and read only where a bound reaches the k-th score."""
    where = f"{shared_dir(spark)}/termloom/sparse-index-{uuid.uuid4().hex}"
    sparse_index.build_sparse_index(retrieval.lexical_vectors(A.table(spark, sf_dir, "documents"), "doc_id", "text"), where)
    return sparse_index.SparseIndex(spark, where).search(retrieval.lexical_weights(A.table(spark, sf_dir, "benchmark"), "item_id", "text"), 10)[0]


@query("hybrid_rrf", f"WITH {_UNIT}, a AS (SELECT query_id, point_id, rank FROM rk WHERE rank <= 40), b AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS point_id, round(list_cosine_similarity(q.e, c.e), 6) AS s FROM vec q JOIN vec c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)), f AS (SELECT query_id, point_id, round(sum(1.0::DOUBLE / (2 + rank - 1)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE rank <= 40) GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM f) SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM fr WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    c, q = A.dense_corpus(spark, sf_dir), A.dense_queries(spark, sf_dir)
    dense = retrieval.dense_topk(c, q, 40)
    filtered = retrieval.dense_topk(c, q, 40, within=("label", "gold"))
    return retrieval.rrf([dense, filtered], limit=10)


@query("vector_index_topk", f"WITH {_UNIT} SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 10")
def vector_index_topk(spark, sf_dir):
    """The same ranking from an index that is written by cell, opened again and searched cell by cell."""
    where = f"{shared_dir(spark)}/termloom/vector-index-{uuid.uuid4().hex}"
    vector_index.build_index(A.dense_corpus(spark, sf_dir), where)
    return vector_index.Index(spark, where).search(A.dense_queries(spark, sf_dir), 10)


_HYBRID = rf"""docs AS (SELECT doc_id AS id, lang, text, embedding AS e FROM documents JOIN embeddings ON doc_id = vec_id),
tk AS (SELECT id, token, count(*) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1)) AS token FROM docs) GROUP BY 1, 2),
kt AS (SELECT id, token, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, token) AS r FROM tk) WHERE r <= 512),
dl AS (SELECT q.id AS query_id, c.id AS point_id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, c.id) AS rank FROM docs q JOIN docs c ON q.lang = c.lang AND q.id <> c.id WHERE q.id % 20 = 0),
sl AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point_id) AS rank FROM (SELECT a.id AS query_id, b.id AS point_id, CAST(sum(a.w * b.w) AS DOUBLE) AS s FROM kt a JOIN kt b USING (token) JOIN docs x ON x.id = a.id JOIN docs y ON y.id = b.id WHERE a.id % 20 = 0 AND x.lang = y.lang AND a.id <> b.id GROUP BY 1, 2)),
fu AS (SELECT query_id, point_id, round(sum(1.0::DOUBLE / (2 + rank - 1)), 9) AS score FROM (SELECT * FROM dl WHERE rank <= 40 UNION ALL SELECT * FROM sl WHERE rank <= 40) GROUP BY 1, 2),
fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM fu)"""


@query("hybrid_dense_sparse", f"WITH {_HYBRID} SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM fk WHERE rank <= 10")
def hybrid_dense_sparse(spark, sf_dir):
    """A dense and a sparse list of documents with vectors, each among those of the query's language, in one fused ranking."""
    v = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text").join(v, "id")
    asked = docs.where("id % 20 = 0")
    dense = (docs.select(F.col("id").alias("point_id"), "vector"), asked.select(F.col("id").alias("query_id"), "vector"))
    sparse = (retrieval.lexical_vectors(docs, "id", "text"), retrieval.lexical_weights(asked, "id", "text"))
    return retrieval.hybrid_topk(dense, sparse, 10, payload=tuple(d.select("id", F.col("lang").alias("value")) for d in (docs, asked)))


@query("neighbour_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark, sf_dir):
    """Cosine of two columns of a row: each vector and that of the next id."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("rerank_signal", f"WITH {_TOK}, h AS (SELECT query_id, point_id, rank FROM srk WHERE rank <= 10), t AS (SELECT query_id, point_id, rank, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '')) AS b FROM h JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = point_id), s AS (SELECT query_id, point_id, rank, CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) ELSE 0 END AS s FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS k FROM s) SELECT b.item_id AS query_id, point_id AS concept, s AS rerank_score, CAST(rank AS INT) AS old_rank, CAST(coalesce(k, 0) AS INT) AS new_rank FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id")
def rerank_signal(spark, sf_dir):
    docs, bench = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "benchmark")
    q = bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieval.sparse_topk(retrieval.lexical_vectors(docs, "doc_id", "text"), retrieval.lexical_weights(bench, "item_id", "text"), 10)
    named = hits.join(docs.select(F.col("doc_id").alias("point_id"), "text"), "point_id").withColumn("concept", F.col("point_id"))
    return retrieval.rerank(q, named, retrieval.overlap_scorer)


_WORDS = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}_]+)', 1)"


@query("exemplar_lookup", f"""WITH q AS (SELECT p_partkey AS query_id, p_name AS text, list_filter({_WORDS.format('p_name')}, lambda w: length(w) > 3) AS w FROM part WHERE p_partkey % 20 = 0), k AS (SELECT query_id, CASE WHEN list_contains(w, lower(trim(text))) THEN w ELSE list_prepend(lower(trim(text)), w) END AS ks FROM q), e AS (SELECT query_id, generate_subscripts(ks, 1) AS key, unnest(ks) AS word FROM k), et AS (SELECT query_id, key, token, count(*) AS weight FROM (SELECT query_id, key, unnest({_WORDS.format('word')}) AS token FROM e) GROUP BY 1, 2, 3),
pt AS (SELECT id, token, count(*) AS weight FROM (SELECT p_partkey AS id, unnest({_WORDS.format('p_name')}) AS token FROM part) GROUP BY 1, 2), s AS (SELECT query_id, key, pt.id AS point_id, CAST(sum(et.weight * pt.weight) AS DOUBLE) AS score FROM et JOIN pt USING (token) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, point_id) AS k FROM s), b AS (SELECT query_id, point_id, max(score) AS score FROM r WHERE k <= 15 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM b) SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM o WHERE rank <= 5""")
def exemplar_lookup(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name").withColumn("text", F.col("p_name"))
    b = A.table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    return retrieval.exemplar_lookup(b, retrieval.lexical_weights(p, "id", "text"))


@query("leave_out_exemplars", f"WITH {_UNIT}, m AS (SELECT *, CASE WHEN label = gold THEN 1 END AS o FROM rk WHERE rank <= 40), s AS (SELECT *, sum(CASE WHEN o IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS place, coalesce(sum(o) OVER (PARTITION BY query_id ORDER BY rank), 0) AS removed FROM m) SELECT query_id, point_id, label AS concept, CAST(rank AS INT) AS rank, CAST(place AS INT) AS place, CAST(removed AS INT) AS removed FROM s WHERE o IS NULL AND place <= 5")
def leave_out_exemplars(spark, sf_dir):
    hits = _top(spark, sf_dir, 40).withColumnRenamed("label", "concept")
    return retrieval.leave_out(hits.select("query_id", "point_id", "concept", "rank"), A.dense_queries(spark, sf_dir).select("query_id", F.col("gold").alias("concept")), 5)


@query("poincare_topk", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 100) AS e FROM embeddings), d AS (SELECT q.vec_id AS query_id, c.vec_id AS point_id, round(acosh(greatest(1 + 2 * list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / ((1 - list_dot_product(q.e, q.e)) * (1 - list_dot_product(c.e, c.e)) + 1e-7), 1.0)), 6) AS distance FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, point_id, distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rank FROM d) WHERE rank <= 10")
def poincare_topk(spark, sf_dir):
    shrink = lambda c: F.transform(c, lambda x: x.cast("double") / 100)
    c = A.dense_corpus(spark, sf_dir).select("point_id", shrink("vector").alias("vector"))
    q = A.dense_queries(spark, sf_dir).select("query_id", shrink("vector").alias("vector"))
    return retrieval.poincare_topk(c, q)


@query("bidirectional_index_rows", "SELECT 2 * p_partkey - 1 AS id, 'en-target' AS direction, 'en' AS lang, p_name AS text, p_brand AS translation FROM part WHERE trim(p_name) <> '' AND trim(p_brand) <> '' UNION ALL SELECT 2 * p_partkey, 'target-en', 'target', p_brand, p_name FROM part WHERE trim(p_name) <> '' AND trim(p_brand) <> ''")
def bidirectional_index_rows(spark, sf_dir):
    return retrieval.bidirectional_rows(A.pairs(spark, sf_dir))


_FORMS_SQL = "SELECT p_partkey AS sctid, fsn, CAST(pos AS INT) AS pos, text FROM (SELECT p_partkey, p_name || ' (' || p_type || ')' AS fsn, unnest([p_name || ' (' || p_type || ')', p_name, p_brand]) AS text, unnest([0, 1, 2]) AS pos FROM part)"


@query("surface_form_points", _FORMS_SQL)
def surface_form_points(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    fsn = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return retrieval.surface_forms(p.select(F.col("p_partkey").alias("sctid"), fsn.alias("fsn"), F.array("p_name", fsn, "p_brand").alias("synonyms")))


@query("threshold_passages", f"WITH {_UNIT}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM rk WHERE rank <= 20 AND score >= 0.2) SELECT query_id, point_id, score, CAST(rank AS INT) AS rank, CAST(label AS VARCHAR) AS text FROM k WHERE r <= 3")
def threshold_passages(spark, sf_dir):
    hits = _top(spark, sf_dir, 20).withColumn("text", F.col("label").cast("string"))
    return retrieval.threshold_passages(hits.select("query_id", "point_id", "score", "rank", "text"), 0.2, 3)


# ---------------------------------------------------------------- pairs and keyed tables
@query("pair_dedupe_first", "SELECT pos, en, target, source FROM (SELECT p_partkey AS pos, trim(p_name) AS en, trim(p_brand) AS target, p_type AS source, row_number() OVER (PARTITION BY lower(trim(p_name)), trim(p_brand) ORDER BY p_partkey) AS r FROM part WHERE trim(p_name) <> '' AND trim(p_brand) <> '') WHERE r = 1")
def pair_dedupe_first(spark, sf_dir):
    return pairs.dedupe_pairs(A.pairs(spark, sf_dir))


_PRIORITY = ("PROMO", "STANDARD", "ECONOMY", "SMALL", "MEDIUM", "LARGE")


@query("pool_union_priority", "SELECT pos, en, target, source FROM (SELECT p_partkey AS pos, p_name AS en, p_brand AS target, p_type AS source, row_number() OVER (PARTITION BY lower(p_name), p_brand ORDER BY coalesce(list_position(['PROMO', 'STANDARD', 'ECONOMY', 'SMALL', 'MEDIUM', 'LARGE'], p_type), 7), p_partkey) AS r FROM part) WHERE r = 1")
def pool_union_priority(spark, sf_dir):
    return pairs.pool_sources(A.pairs(spark, sf_dir), _PRIORITY)


@query("pool_distinct", "SELECT DISTINCT p_name AS en, p_brand AS target FROM part")
def pool_distinct(spark, sf_dir):
    p = A.pairs(spark, sf_dir).select("en", "target")
    return pairs.pool_distinct([p, p])


@query("last_wins_key", "SELECT o_custkey, o_orderkey AS pos, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_wins_key(spark, sf_dir):
    return pairs.last_wins(A.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), "o_totalprice"), "o_custkey")


@query("surface_form_gold", "WITH t AS (SELECT lower(trim(p_name)) AS key, p_partkey AS sctid, p_type AS tag, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS r FROM part), g AS (SELECT t.sctid, p.p_brand AS target, t.tag AS hierarchy, p.p_name AS en, row_number() OVER (PARTITION BY t.sctid ORDER BY p.p_partkey) AS r FROM part p JOIN t ON t.key = lower(trim(p.p_name)) AND t.r = 1) SELECT sctid, target, hierarchy, en FROM g WHERE r = 1")
def surface_form_gold(spark, sf_dir):
    return pairs.surface_gold(A.fsn_terms(spark, sf_dir), A.pairs(spark, sf_dir))


@query("preferred_min_by", "SELECT l_orderkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_linenumber, l_shipdate) AS r FROM lineitem) WHERE r = 1")
def preferred_min_by(spark, sf_dir):
    return pairs.preferred(A.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate", F.col("l_returnflag") == "N", "l_linenumber")


@query("acceptable_terms", "SELECT p_brand, array_to_string(list(p_name ORDER BY f), '; ') AS acceptables FROM (SELECT p_brand, p_name, min(p_partkey) AS f FROM part GROUP BY 1, 2) GROUP BY p_brand")
def acceptable_terms(spark, sf_dir):
    return pairs.acceptable_terms(A.table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query("unpivot_parts", "SELECT p_partkey, CAST(part AS INT) AS part, en, target FROM (SELECT p_partkey, unnest([0, 1]) AS part, unnest([p_name, p_type]) AS en, unnest([p_brand, CAST(p_size AS VARCHAR)]) AS target FROM part) WHERE trim(en) <> '' AND trim(target) <> ''")
def unpivot_parts(spark, sf_dir):
    return pairs.unpivot_parts(A.table(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_type"], ["p_brand", "p_size"])


@query("vocabulary_pairs", "SELECT p.p_name AS en, s.s_name AS target, p.p_type AS source FROM part p JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3) s ON s.s_suppkey = p.p_partkey WHERE p.p_type IN ('PROMO', 'SMALL', 'STANDARD')")
def vocabulary_pairs(spark, sf_dir):
    c = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), F.col("p_type").alias("vocabulary_id"))
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("concept_id"), F.col("s_name").alias("concept_synonym_name"), F.col("s_nationkey").cast("string").alias("language_concept_id"))
    return SRC.vocabulary_pairs(c, s, ["PROMO", "SMALL", "STANDARD"], "3")


@query("resume_by_key", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_by_key(spark, sf_dir):
    from .sources.tables import resume_by_key as resume

    done = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume(A.table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("left_joins_filled", "SELECT c_custkey, c_name, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def left_joins_filled(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return pairs.fill_left(A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), [n], "c_nationkey").select("c_custkey", "c_name", "n_name")


@query("positional_zip", "SELECT p_partkey AS pos, p_name AS a, s_name AS b FROM part JOIN supplier ON p_partkey = s_suppkey")
def positional_zip(spark, sf_dir):
    a = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("a"))
    return pairs.zip_tables(a, A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("b")))


@query("consensus", "SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def consensus(spark, sf_dir):
    a = A.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    b = A.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "good").otherwise("bad").alias("label"))
    return pairs.consensus(a, b, "doc_id", "label", "good")


@query("regression_set", "SELECT doc_id FROM (SELECT l.doc_id, md5('7:' || CAST(l.doc_id AS VARCHAR)) AS h FROM labels l WHERE l.quality = 1 AND l.toxic <> 1) ORDER BY h LIMIT 50")
def regression_set(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels")
    return pairs.regression_set(rows.select("doc_id", (F.col("quality") == 1).alias("exact")), rows.select("doc_id", (F.col("toxic") == 1).alias("exact")), "doc_id", "7", 50).select("doc_id")


# ---------------------------------------------------------------- text
@query("norm_exact_multi_ref", "SELECT p_partkey, list_contains([trim(replace(p_type || ' x', ' ', '')), trim(replace(p_name, ' ', ''))], trim(replace(CASE WHEN p_size % 3 = 0 THEN ' ' || p_type || 'x ' WHEN p_size % 3 = 1 THEN p_name ELSE p_brand END, ' ', ''))) AS exact FROM part")
def norm_exact_multi_ref(spark, sf_dir):
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), "p_type", F.lit("x "))).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(F.col("p_brand"))
    return A.table(spark, sf_dir, "part").select("p_partkey", S.exact_match(said, F.array(F.concat("p_type", F.lit(" x")), "p_name")).alias("exact"))


@query("char_sim", "WITH s AS (SELECT p_partkey, regexp_replace(p_name || ' ' || p_type, '\\s+', '', 'g') AS a, regexp_replace(p_brand || ' ' || p_name, '\\s+', '', 'g') AS b FROM part) SELECT p_partkey, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1), 6) AS char_sim FROM s")
def char_sim(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", F.round(S.char_similarity(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_brand", "p_name")), 6).alias("char_sim"))


@query("token_jaccard", "WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS a FROM conversations), b AS (SELECT x.conv_id, x.turn, x.a, y.a AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) ELSE 0 END, 6) AS jaccard FROM b")
def token_jaccard(spark, sf_dir):
    """Each turn against the next one of its conversation."""
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.token_jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


@query("char_jaccard", "WITH s AS (SELECT p_partkey, list_distinct(string_split(lower(replace(p_name, ' ', '')), '')) AS a, list_distinct(string_split(lower(replace(p_brand, ' ', '')), '')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 6) AS jaccard FROM s")
def char_jaccard(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", F.round(S.char_jaccard(F.col("p_name"), F.col("p_brand")), 6).alias("jaccard"))


_CHRF = """WITH s AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS h, replace(p_type || ' ' || p_name, ' ', '') AS r FROM part),
o AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n),
hg AS (SELECT id, n, substring(h, i, n) AS g, count(*) AS c FROM (SELECT id, h, n, unnest(range(1, greatest(length(h) - n + 2, 1))) AS i FROM s, o) GROUP BY 1, 2, 3),
rg AS (SELECT id, n, substring(r, i, n) AS g, count(*) AS c FROM (SELECT id, r, n, unnest(range(1, greatest(length(r) - n + 2, 1))) AS i FROM s, o) GROUP BY 1, 2, 3),
m AS (SELECT id, n, sum(least(hg.c, rg.c)) AS same FROM hg JOIN rg USING (id, n, g) GROUP BY 1, 2),
k AS (SELECT s.id, o.n, length(h) - o.n + 1 AS hn, length(r) - o.n + 1 AS rn FROM s, o WHERE length(h) >= o.n AND length(r) >= o.n),
a AS (SELECT k.id, avg(coalesce(same, 0)::DOUBLE / hn) AS p, avg(coalesce(same, 0)::DOUBLE / rn) AS q FROM k LEFT JOIN m USING (id, n) GROUP BY 1)
SELECT s.id, round(coalesce(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) * 100 END, 0), 4) AS chrf FROM s LEFT JOIN a USING (id)"""


@query("chrf_best_ref", _CHRF)
def chrf_best_ref(spark, sf_dir):
    p = widened(A.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    best = S.best_chrf(F.col("p_name"), F.array(F.concat("p_type", F.lit(" "), "p_name")))
    return p.select(F.col("p_partkey").alias("id"), F.round(best["chrf"], 4).alias("chrf"))


_RULES = (H.HardRule("no-green", "no green", "green", penalty=0.25), H.HardRule("end-red", "red at the end", r"red$", regex=True, penalty=0.5), H.HardRule("keep", "keep", "", enforce=False, freeze="Keep brand names"))


@query("hard_rule_penalty", "SELECT p_partkey, (CASE WHEN contains(p_name, 'green') THEN 0.25 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, 'red$') THEN 0.5 ELSE 0 END)::DOUBLE AS penalty, CAST((CASE WHEN contains(p_name, 'green') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, 'red$') THEN 1 ELSE 0 END) AS INT) AS n FROM part")
def hard_rule_penalty(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", H.penalty(F.col("p_name"), _RULES).alias("penalty"), F.size(H.violations(F.col("p_name"), _RULES)).alias("n"))


_FORMS = ("red", "green", "large", "tin", "steel", "brass", "copper", "blue", "small")


@query("longest_form_match", "SELECT p_partkey, list_filter(['copper', 'brass', 'green', 'large', 'small', 'steel', 'blue', 'red', 'tin'], lambda x: contains(p_name, x))[1] AS form FROM part")
def longest_form_match(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", T.longest_form(F.col("p_name"), _FORMS).alias("form"))


@query("semantic_tag", "SELECT p_partkey, p_type AS tag, p_name AS term FROM part")
def semantic_tag(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").withColumn("fsn", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
    return p.select("p_partkey", T.semantic_tag(F.col("fsn")).alias("tag"), T.parse_fsn(F.col("fsn"))[0].alias("term"))


@query("role_projection", "SELECT p_partkey AS pos, p_name AS en, p_brand AS target FROM part")
def role_projection(spark, sf_dir):
    from .plans.roles import resolve_roles

    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("english"), F.col("p_brand").alias("KO"))
    return SRC.role_rows(p, {k: v for k, v in resolve_roles(p.columns).items() if k in ("en", "target")})


@query("reply_parse_best", "SELECT p_partkey, CASE WHEN p_size % 7 BETWEEN 1 AND 4 THEN CAST(p_size % 7 AS INT) END AS best, p_brand AS reason FROM part")
def reply_parse_best(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    reply = F.concat(F.lit("<think>BEST: 3</think>BEST: 9 then\nBEST: "), (F.col("p_size") % 7).cast("string"), F.lit("\nREASON: "), "p_brand", F.lit("\nend"))
    return p.select("p_partkey", R.best_index(reply, F.lit(4)).alias("best"), R.reason(reply).alias("reason"))


@query("template_render", "SELECT p_partkey, 'Term: ' || p_name || ' / ' || p_brand || '.' AS prompt FROM part")
def template_render(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", T.render_template("Term: {{en}} / {{target}}.", {"en": F.col("p_name"), "target": F.col("p_brand")}).alias("prompt"))


@query("normalize_key", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS key FROM documents")
def normalize_key(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.normalize_key(F.col("text")).alias("key"))


#: Classes of white space, words and line breaks, as DuckDB's expressions spell them.
_DSP = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DW = r"\p{L}\p{N}_"
_DBREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_DURL = rf"(?i)https?://[^{_DSP}]+|www\.[^{_DSP}]+"
_DMAIL = rf"[{_DW}][{_DW}.+-]*@[{_DW}-]+\.[{_DW}.-]*[{_DW}]"


def _template(sql: str) -> str:
    """SQL for ``format`` with its argument at @@."""
    return sql.replace("{", "{{").replace("}", "}}").replace("@@", "{0}")


_NORM = _template(rf"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(@@, '\r\n?', chr(10), 'g'), '{_DURL}', ' ', 'g'), '{_DMAIL}', ' ', 'g'), '\p{{Nd}}+', ' ', 'g')), '[^{_DW}{_DSP}]', ' ', 'g'), '[{_DSP}]+', ' ', 'g'), ' ')")


@query("corpus_normalize", f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def corpus_normalize(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.corpus_normalize(F.col("text")).alias("norm"))


@query("script_checks", "SELECT doc_id, regexp_matches(text, '[가-힣]') AS hangul, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '[õäöüšžÕÄÖÜŠŽ]') AS marks FROM documents")
def script_checks(spark, sf_dir):
    t = F.col("text")
    return A.table(spark, sf_dir, "documents").select("doc_id", T.has_hangul(t).alias("hangul"), T.has_latin(t).alias("latin"), T.has_estonian_marks(t).alias("marks"))


@query("html_terms", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS body FROM pages) WHERE trim(regexp_replace(regexp_replace(regexp_extract(body, '(?s)^(.*)$', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') <> '' GROUP BY page_id")
def html_terms(spark, sf_dir):
    t = SRC.html_terms(A.table(spark, sf_dir, "pages"), r"(?s)<p[^>]*>(.*?)</p>", r"(?s)^(.*)$", r"(?s)^(.*)$")
    return t.groupBy("page_id").agg(F.count("*").alias("n"))


@query("page_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"#]+)\"', 1)) AS link FROM pages")
def page_links(spark, sf_dir):
    return SRC.page_links(A.table(spark, sf_dir, "pages"))


@query("difflib_ratio")
def difflib_ratio(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", F.round(S.difflib_ratio(F.col("p_name"), F.col("p_brand")), 6).alias("ratio"))


# ---------------------------------------------------------------- metrics
_SCORED = "WITH s AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS exact, p_size * 2.0::DOUBLE AS chrf FROM part)"


def _scored(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3 == 0).cast("int").alias("exact"), (F.col("p_size") * 2.0).alias("chrf"))


@query("composite_score", f"{_SCORED} SELECT count(*) AS n, round(avg(exact) * 100, 6) AS exact_match_pct, round(avg(chrf), 6) AS mean_chrf, round((0.2::DOUBLE * avg(exact) + 0.5::DOUBLE * avg(chrf) / 100) / 0.7::DOUBLE, 6) AS composite_score FROM s")
def composite_score(spark, sf_dir):
    return metrics.composite_metrics(_scored(spark, sf_dir))


@query("formula_score", f"{_SCORED} SELECT p_partkey, round(greatest(exact * 2.0::DOUBLE, chrf / 10) - (chrf - 7 * floor(chrf / 7)), 6) AS score FROM s")
def formula_score(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("p_partkey", F.round(H.formula_column("max(exact * 2, chrf / 10) - chrf % 7", {"exact": F.col("exact"), "chrf": F.col("chrf")}), 6).alias("score"))


@query("recall_by_hierarchy", "WITH r AS (SELECT p_type, p_size % 14 AS k FROM part) SELECT p_type, count(*) AS n_queries, round(100.0 * avg(CASE WHEN k BETWEEN 1 AND 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_1, round(100.0 * avg(CASE WHEN k BETWEEN 1 AND 3 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_3, round(100.0 * avg(CASE WHEN k BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_5, round(100.0 * avg(CASE WHEN k BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_10, round(avg(CASE WHEN k > 0 THEN 1.0::DOUBLE / k ELSE 0 END), 4) AS mrr FROM r GROUP BY p_type")
def recall_by_hierarchy(spark, sf_dir):
    return metrics.recall_metrics(A.table(spark, sf_dir, "part").select("p_type", (F.col("p_size") % 14).alias("correct_rank")), by=["p_type"])


_LAB = "WITH d AS (SELECT l.doc_id, round(log10(d.n_chars + 1.0::DOUBLE), 6) AS score, l.quality, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id))"


@query("auc_rank_sum", f"{_LAB}, p AS (SELECT lang, score, count(*) AS n, sum(quality) AS pos FROM d GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p), s AS (SELECT lang, sum(pos * (below + (n + 1) / 2.0::DOUBLE)) AS rs, sum(pos) AS np, sum(n - pos) AS nn FROM b GROUP BY lang) SELECT lang, round(CASE WHEN np * nn > 0 THEN (rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn)::DOUBLE END, 6) AS auc, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg FROM s")
def auc_rank_sum(spark, sf_dir):
    return metrics.auc(A.scored_labels(spark, sf_dir), "score", "quality", ["lang"])


@query("precision_coverage_curve", f"{_LAB}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM d), t AS (SELECT i, lo + (hi - lo) * (i / 10.0::DOUBLE) AS t FROM e, (SELECT unnest(range(10)) AS i)) SELECT CAST(i AS INT) AS step, round(t, 6) AS threshold, CAST(count(*) FILTER (WHERE score >= t) AS BIGINT) AS n, round(count(*) FILTER (WHERE score >= t)::DOUBLE / count(*), 6) AS coverage, round(coalesce(count(*) FILTER (WHERE score >= t AND quality = 1)::DOUBLE / nullif(count(*) FILTER (WHERE score >= t), 0), 0), 6) AS precision FROM d, t GROUP BY i, t")
def precision_coverage_curve(spark, sf_dir):
    return metrics.precision_coverage(A.scored_labels(spark, sf_dir), "score", "quality")


@query("error_detector", f"{_LAB} SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_flagged, count(*) FILTER (WHERE quality < 0.6) AS n_wrong, round(coalesce(count(*) FILTER (WHERE toxic = 1 AND quality < 0.6)::DOUBLE / nullif(count(*) FILTER (WHERE toxic = 1), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (WHERE toxic = 1 AND quality < 0.6)::DOUBLE / nullif(count(*) FILTER (WHERE quality < 0.6), 0), 0), 6) AS recall, count(*) FILTER (WHERE toxic <> 1) AS n_clean, round(coalesce(count(*) FILTER (WHERE toxic <> 1 AND quality >= 0.6)::DOUBLE / nullif(count(*) FILTER (WHERE toxic <> 1), 0), 0), 6) AS clean_accuracy FROM d")
def error_detector(spark, sf_dir):
    return metrics.error_detector(A.scored_labels(spark, sf_dir), "quality", F.col("toxic") == 1)


@query("confidence_calibration", "WITH r AS (SELECT p_size % 5 + 1 AS level, p_retailprice AS v, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS e FROM part), p AS (SELECT level, count(*) AS n, sum(v) AS v, sum(e) AS e FROM r GROUP BY level) SELECT level, n, round(v / n, 6) AS mean_value, round(e::DOUBLE / n, 6) AS exact_share, round(sum(n) OVER (ORDER BY level DESC)::DOUBLE / sum(n) OVER (), 6) AS kept_share, round(sum(v) OVER (ORDER BY level DESC) / sum(n) OVER (ORDER BY level DESC), 6) AS kept_mean FROM p")
def confidence_calibration(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select((F.col("p_size") % 5 + 1).alias("level"), F.col("p_retailprice").alias("v"), (F.col("p_size") % 3 == 0).cast("int").alias("e"))
    return metrics.calibration(p, "level", "v", "e")


@query("label_similarity_crosstab", "SELECT CASE WHEN s >= 0.75 THEN 0.75 WHEN s >= 0.5 THEN 0.5 WHEN s >= 0.25 THEN 0.25 ELSE 0.0 END::DOUBLE AS bucket, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'de') AS n_de, count(*) FILTER (WHERE lang = 'fr') AS n_fr, count(*) AS total FROM (SELECT lang, (n_chars % 100) / 100.0::DOUBLE AS s FROM documents) GROUP BY 1")
def label_similarity_crosstab(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("lang", ((F.col("n_chars") % 100) / 100.0).alias("s"))
    return metrics.similarity_crosstab(d, "s", "lang", ["en", "de", "fr"])


@query("label_spread", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS INT) + 1] AS median, min(n_chars) AS least, max(n_chars) AS greatest FROM documents GROUP BY lang")
def label_spread(spark, sf_dir):
    return metrics.label_spread(A.table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("value_percentiles", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def value_percentiles(spark, sf_dir):
    return metrics.percentiles(A.table(spark, sf_dir, "events"), "value", ["event_type"])


_VERDICT = "WITH v AS (SELECT conv_id AS id, CASE WHEN conv_id % 11 = 0 THEN 'identical' ELSE 'pass' || CAST(turn % 2 AS VARCHAR) END AS mode, CASE length(text) % 5 WHEN 0 THEN 'tie' WHEN 1 THEN NULL WHEN 2 THEN 'B' ELSE 'A' END AS winner FROM conversations)"


def _verdicts(spark, sf_dir):
    n = F.length("text") % 5
    return A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 11 == 0, "identical").otherwise(F.concat(F.lit("pass"), (F.col("turn") % 2).cast("string"))).alias("mode"), F.when(n == 0, "tie").when(n == 1, F.lit(None)).when(n == 2, "B").otherwise("A").alias("winner"))


@query("pairwise_verdict_summary", f"{_VERDICT}, p AS (SELECT id, max(CASE WHEN mode = 'identical' THEN 1 ELSE 0 END) AS same, max(CASE WHEN winner IS NULL THEN 1 ELSE 0 END) AS bad, count(DISTINCT winner) AS kinds, min(winner) AS w FROM v GROUP BY id) SELECT CASE WHEN same = 1 THEN 'identical' WHEN bad = 1 THEN 'error' WHEN kinds = 1 THEN 'consistent_' || w ELSE 'inconsistent' END AS outcome, count(*) AS n FROM p GROUP BY 1")
def pairwise_verdict_summary(spark, sf_dir):
    return metrics.pairwise_summary(_verdicts(spark, sf_dir))


@query("judge_tally_rollup", f"{_VERDICT} SELECT coalesce(mode, '__ALL__') AS hierarchy, winner, count(*) AS n FROM v GROUP BY GROUPING SETS ((mode, winner), (winner))")
def judge_tally_rollup(spark, sf_dir):
    return metrics.tally(_verdicts(spark, sf_dir), "mode", "winner")


@query("score_histogram", "SELECT event_type, CAST(least(floor((value - floor(value)) * 50), 49) AS INT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def score_histogram(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("x", F.col("value") - F.floor("value"))
    return metrics.histogram(e, "x", 50, ["event_type"])


@query("top_coverage_precision", f"{_LAB}, r AS (SELECT quality, row_number() OVER (ORDER BY score DESC, quality DESC) AS k, count(*) OVER () AS n FROM d) SELECT CAST(count(*) AS BIGINT) AS kept, round(avg(quality), 6) AS precision FROM r WHERE k <= floor(n * 0.3::DOUBLE)")
def top_coverage_precision(spark, sf_dir):
    return metrics.top_coverage_precision(A.scored_labels(spark, sf_dir), "score", "quality", 0.3)


@query("token_cost", "SELECT role, count(*) AS n, round((sum(length(text)) * 3.0::DOUBLE + sum(turn) * 15.0::DOUBLE) / 1e6, 6) AS cost FROM conversations GROUP BY role")
def token_cost(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    return metrics.token_cost(c, "chars", "turn", (3.0, 15.0), ["role"])


@query("dimension_means", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean_n_chars, round(avg(doc_id), 6) AS mean_doc_id FROM documents GROUP BY lang HAVING count(*) >= 10")
def dimension_means(spark, sf_dir):
    return reports.dimension_means(A.table(spark, sf_dir, "documents"), ["n_chars", "doc_id"], ["lang"], 10)


@query("source_split_summary", f"{_SCORED}, p AS (SELECT s.*, p_size FROM s JOIN part USING (p_partkey)) SELECT count(*) AS all_n, round(avg(chrf), 6) AS all_mean, round(avg(exact), 6) AS all_exact, count(*) FILTER (WHERE p_size < 20) AS small_n, round(avg(chrf) FILTER (WHERE p_size < 20), 6) AS small_mean, round(avg(exact) FILTER (WHERE p_size < 20), 6) AS small_exact FROM p")
def source_split_summary(spark, sf_dir):
    return reports.source_split(_scored(spark, sf_dir).join(A.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), "chrf", "exact", {"small": F.col("p_size") < 20})


@query("label_counts_cost", "SELECT coalesce(event_type, '(none)') AS label, count(*) AS n, round(sum(value), 6) AS cost FROM events GROUP BY 1")
def label_counts_cost(spark, sf_dir):
    return reports.label_counts(A.table(spark, sf_dir, "events"), "event_type", "value")


@query("round_trip_ceiling", "WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS r, p_retailprice AS s, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS c FROM part) SELECT count(*) AS n, round(avg(r), 6) AS recovery, round(avg(c), 6) AS ceiling, round(avg(s) FILTER (WHERE r = 1), 6) AS mean_recovered_score, CAST(count(*) FILTER (WHERE c = 1 AND r = 0) AS BIGINT) AS lost FROM a")
def round_trip_ceiling(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    row = lambda k: p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % k == 0).cast("int").alias("recovered"), F.col("p_retailprice").alias("score"))
    return reports.round_trip(row(3), row(2))


@query("groups_with_rest", "WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), x AS (SELECT CASE WHEN g.n >= 80 THEN part.p_brand ELSE '(other)' END AS name, p_retailprice FROM part JOIN g USING (p_brand)) SELECT name, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM x GROUP BY name")
def groups_with_rest(spark, sf_dir):
    return reports.groups_with_rest(A.table(spark, sf_dir, "part"), "p_brand", 80, "p_retailprice")


@query("eval_set_coverage", "SELECT count(*) AS concepts, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS with_target, round(count(CASE WHEN s_acctbal > 0 THEN 1 END)::DOUBLE / count(*), 6) AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def eval_set_coverage(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").withColumn("sctid", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    root = spark.createDataFrame([("r1",)], "node string")
    return reports.eval_set(A.is_a(spark, sf_dir), root, s.select("sctid", F.col("s_name").alias("en")), s.where("s_acctbal > 0").select("sctid", F.col("s_name").alias("target")))[1]


@query("site_lookup", "SELECT c_custkey, coalesce(n_name || ' (also: ' || r_name || ')', '') AS site FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def site_lookup(spark, sf_dir):
    n, r = A.table(spark, sf_dir, "nation").where("n_nationkey < 20"), A.table(spark, sf_dir, "region")
    t = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("term"), F.array("r_name").alias("others"))
    c = A.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("k"))
    return reports.site_lookup(c, "k", t).select("c_custkey", "site")


@query("run_compare", "SELECT p_partkey, p_name AS before, p_type AS after, CASE WHEN p_name = p_type THEN 1 ELSE 0 END AS same FROM part")
def run_compare(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return reports.axis_compare(p.select("p_partkey", F.lit("").alias("translation"), F.col("p_name").alias("candidate")), p.select("p_partkey", F.col("p_type").alias("candidate")), "p_partkey", ["translation", "candidate"])


@query("dictionary_lookup", "WITH d AS (SELECT lower(n_name) AS k, n_nationkey AS v FROM nation UNION ALL SELECT lower(n_name) || ' structure', n_nationkey FROM nation) SELECT s_suppkey AS id, CAST(d.v AS VARCHAR) AS value FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN d ON d.k = lower(n_name) || CASE WHEN s_suppkey % 2 = 0 THEN ' structure' ELSE '' END")
def dictionary_lookup(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    s = A.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = s.select(F.col("s_suppkey").alias("id"), F.lit("").alias("direct"), F.concat("n_name", F.when(F.col("s_suppkey") % 2 == 0, " structure").otherwise("")).alias("indirect"))
    return graph.dictionary_lookup(rows, ["direct", "indirect"], n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")))


# ---------------------------------------------------------------- corpus cleaning
def _lines(spark, sf_dir):
    return corpus.clean_lines(A.corpus_docs(spark, sf_dir))


_DSTRIP = _template(rf"regexp_replace(@@, '^[{_DSP}]+|[{_DSP}]+$', '', 'g')")
_BARE = _DSTRIP.format("l")


def _word(words: str) -> str:
    return rf"regexp_matches({_BARE}, '(?i)(^|[^{_DW}])({words})($|[^{_DW}])')"


_NOISE = " OR ".join([
    rf"regexp_matches({_BARE}, '(?i)^(page|lk\.?|lehek(ülg|g))?[{_DSP}]*\p{{Nd}}+[{_DSP}]*((/|of)[{_DSP}]*\p{{Nd}}+)?$')",
    f"regexp_matches({_BARE}, '{_DURL}')",
    f"regexp_matches({_BARE}, '{_DMAIL}')",
    f"regexp_matches({_BARE}, '^[-_=]{{4,}}$')",
    rf"(regexp_matches({_BARE}, '\+?\p{{Nd}}[\p{{Nd}}{_DSP}().-]{{6,}}\p{{Nd}}') AND {_word('tel|telefon|phone|kontakt')})",
    f"({_word('koostaja|author|authors|contact|kontakt|version|versioon')} AND length({_BARE}) <= 200)",
    rf"({_word('tn|tänav|street|st|road|rd|ave|avenue|puiestee')} AND regexp_matches({_BARE}, '\p{{Nd}}') AND length({_BARE}) <= 200)",
])


@query("noise_lines", f"SELECT doc_id, CAST(sum(CASE WHEN {_BARE} <> '' AND ({_NOISE}) THEN 1 ELSE 0 END) AS BIGINT) AS noise, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def noise_lines(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return d.groupBy("doc_id").agg(F.sum(T.is_layout_noise(F.col("l")).cast("long")).alias("noise"), F.count("*").alias("lines"))


# The same steps in DuckDB: a fold over all lines carries whether they are skipped.
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`([^`]*)`', '\1', 'g'), '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g')"
_NAMED = " OR ".join(f"contains(lower(title), '{k}')" for k in T.SECTION_KEYWORDS)
_SKIPPED = rf"""{A.CORPUS_SQL},
li AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM (SELECT doc_id, regexp_split_to_array({_STRIPPED}, '{_DBREAK}') AS ls FROM cd)),
lh AS (SELECT *, regexp_extract(l, '^(#{{1,6}})[{_DSP}]+((?s).*)$', 1) AS hs, {_BARE} AS bare, regexp_replace({_BARE}, '[^A-Za-zÀ-ÖØ-öø-ÿÕÄÖÜŠŽ{_DSP}-]', '', 'g') AS letters FROM li),
lt AS (SELECT *, hs <> '' AS md, hs = '' AND bare <> '' AND length(bare) <= 120 AND letters <> '' AND letters = upper(letters) AND NOT contains(letters, 'ß') AND len(list_filter(regexp_split_to_array(letters, '[{_DSP}]+'), lambda x: x <> '')) <= 10 AS caps FROM lh),
ln AS (SELECT *, md OR caps AS h, CASE WHEN md THEN length(hs) END AS hl, CASE WHEN md THEN {_DSTRIP.format("regexp_extract(l, '^(#{1,6})[" + _DSP + "]+((?s).*)$', 2)")} WHEN caps THEN bare ELSE '' END AS title FROM lt),
lf AS (SELECT doc_id, i, l, h, hl, h AND ({_NAMED}) AS named FROM ln),
lr AS (SELECT doc_id, list({{'skip': false, 'level': NULL::BIGINT, 'h': h, 'hl': hl::BIGINT, 'named': named}} ORDER BY i) AS ls, list(l ORDER BY i) AS texts FROM lf GROUP BY doc_id),
hd AS (SELECT doc_id, list_filter(list_transform(ls, lambda x, i: {{'i': i, 'hl': x.hl, 'named': x.named, 'h': x.h, 'skip': false, 'level': NULL::BIGINT, 'out': []::STRUCT(i BIGINT, skip BOOLEAN)[]}}), lambda x: x.h) AS hs, texts FROM lr),
fo AS (SELECT doc_id, texts, list_reduce(list_prepend({{'i': 0::BIGINT, 'hl': NULL::BIGINT, 'named': false, 'h': false, 'skip': false, 'level': NULL::BIGINT, 'out': []::STRUCT(i BIGINT, skip BOOLEAN)[]}}, hs), lambda a, x: {{'i': x.i, 'hl': x.hl, 'named': x.named, 'h': x.h,
  'skip': (a.skip AND NOT (x.hl IS NULL OR a.level IS NULL OR x.hl <= a.level)) OR x.named,
  'level': CASE WHEN NOT (a.skip AND NOT (x.hl IS NULL OR a.level IS NULL OR x.hl <= a.level)) AND x.named THEN x.hl WHEN a.skip AND NOT (x.hl IS NULL OR a.level IS NULL OR x.hl <= a.level) THEN a.level END,
  'out': list_append(a.out, {{'i': x.i, 'skip': (a.skip AND NOT (x.hl IS NULL OR a.level IS NULL OR x.hl <= a.level)) OR x.named}})}}).out AS marks FROM hd),
ex AS (SELECT doc_id, generate_subscripts(texts, 1) AS i, unnest(texts) AS l FROM fo),
mk AS (SELECT doc_id, m.i AS i, m.skip AS skip FROM (SELECT doc_id, unnest(marks) AS m FROM fo)),
sk AS (SELECT ex.doc_id, ex.i, ex.l, coalesce(mk.skip, false) AS skip FROM ex ASOF LEFT JOIN mk ON ex.doc_id = mk.doc_id AND ex.i >= mk.i),
cl AS (SELECT doc_id, i, l FROM sk WHERE NOT skip AND NOT ({_BARE} <> '' AND ({_NOISE}))),
ct AS (SELECT cd.doc_id, coalesce(c.text, '') AS text, coalesce(c.n, 0) AS n FROM cd LEFT JOIN (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text, count(*) AS n FROM cl GROUP BY doc_id) c USING (doc_id))"""
_STRIP = _DSTRIP
_CHUNKED = rf"""{_SKIPPED},
ca AS (SELECT doc_id, list_filter(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n[{_DSP}]*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> ''), lambda p: CASE WHEN length(p) <= 800 THEN [p] ELSE list_transform(string_split(p, chr(10)), lambda q: {_STRIP.format('q')}) END)), lambda p: length(p) >= 40) AS ps FROM ct),
cu AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS ordinal, unnest(ps) AS raw FROM ca),
ch AS (SELECT doc_id, ordinal, raw, {_NORM.format('raw')} AS norm FROM cu)"""
_THRESHOLD = "th AS (SELECT CASE WHEN count(*) <= 1 THEN 1 ELSE least(count(*), greatest(2, CAST(ceil(count(*) * 0.02::DOUBLE - 1e-9) AS BIGINT))) END AS t FROM documents)"
_EDGED = rf"""ed AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {_DSTRIP.format('x')} <> '') AS ls FROM ct WHERE n > 0),
eb AS (SELECT doc_id, edge, {_NORM.format('block')} AS norm FROM (SELECT doc_id, 'start' AS edge, array_to_string(ls[1:3], chr(10)) AS block FROM ed WHERE len(ls) > 0 UNION ALL SELECT doc_id, 'end', array_to_string(ls[-3:], chr(10)) FROM ed WHERE len(ls) > 0)),
fe AS (SELECT norm, sum(n) AS n FROM (SELECT edge, norm, count(DISTINCT doc_id) AS n FROM eb WHERE norm <> '' GROUP BY 1, 2) GROUP BY norm HAVING sum(n) >= (SELECT t FROM th))"""


def _lsh_sql(source: str) -> str:
    """(norm) of the near-duplicate chunks of ``source(doc_id, norm)``, with all 64 hash functions in 16 bands."""
    functions = ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in corpus.family(64))
    return f"""sw AS (SELECT norm, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT norm FROM {source} WHERE norm <> '')),
sx AS (SELECT norm, list_transform(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE w END), lambda x: CAST('0x' || left(md5(x), 7) AS BIGINT)) AS xs FROM sw),
sg AS (SELECT norm, list_transform([{functions}], lambda f: list_min(list_transform(xs, lambda x: (f.a * x + f.b) % {corpus.PRIME}))) AS sig FROM sx WHERE len(xs) > 0),
sb AS (SELECT norm, unnest(range(16)) AS band, sig FROM sg),
sk2 AS (SELECT norm, band, array_to_string(sig[band * 4 + 1:band * 4 + 4], '|') AS key FROM sb),
sh AS (SELECT band, key FROM sk2 JOIN (SELECT DISTINCT norm, doc_id FROM {source}) d USING (norm) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= (SELECT t FROM th)),
hot AS (SELECT DISTINCT norm FROM sk2 SEMI JOIN sh USING (band, key))"""


@query("section_skip", f"WITH {_SKIPPED} SELECT doc_id, CAST(n AS INT) AS n_lines, md5(text) AS digest FROM ct")
def section_skip(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest"))


@query("chunk_paragraphs", f"WITH {_CHUNKED} SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(length(raw) AS INT) AS chars, md5(norm) AS norm_md5 FROM ch")
def chunk_paragraphs(spark, sf_dir):
    return corpus.chunks(_lines(spark, sf_dir)).select("doc_id", "ordinal", F.length("raw").alias("chars"), F.md5(F.col("norm").cast("binary")).alias("norm_md5"))


_PARA = f"p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: length(x) >= 40)) AS raw FROM documents), c AS (SELECT doc_id, {_NORM.format('raw')} AS norm FROM p)"


@query("chunk_df_boilerplate", f"WITH {_PARA}, t AS (SELECT CASE WHEN count(*) <= 1 THEN 1 ELSE least(count(*), greatest(2, CAST(ceil(count(*) * 0.02::DOUBLE - 1e-9) AS BIGINT))) END AS t FROM documents) SELECT norm, count(DISTINCT doc_id) AS n FROM c, t GROUP BY norm, t HAVING count(DISTINCT doc_id) >= t")
def chunk_df_boilerplate(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: F.length(x) >= 40)
    return corpus.frequent_texts(d, lines, corpus.document_threshold(d.count()))


@query("edge_block_df", f"WITH {_SKIPPED}, {_THRESHOLD}, {_EDGED} SELECT md5(norm) AS norm_md5, CAST(n AS BIGINT) AS n FROM fe")
def edge_block_df(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return corpus.frequent_edges(corpus.edge_blocks(lines), corpus.document_threshold(A.table(spark, sf_dir, "documents").count())).select(F.md5(F.col("norm").cast("binary")).alias("norm_md5"), "n")


_FEW = ", ".join(f"list_min(list_transform(x, lambda v: ({a} * v + {b}) % {corpus.PRIME})) AS h{i}" for i, (a, b) in enumerate(corpus.family(4)))


@query("minhash_bands", "WITH b AS (SELECT item_id, " + _NORM.format("text") + f" AS norm FROM benchmark), w AS (SELECT item_id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM b), s AS (SELECT item_id, list_transform(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE w END), lambda x: CAST('0x' || left(md5(x), 7) AS BIGINT)) AS x FROM w) SELECT item_id, {_FEW} FROM s")
def minhash_bands(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark").withColumn("sig", corpus.signature(T.corpus_normalize(F.col("text")), 4))
    return b.select("item_id", *[F.col("sig")[i].alias(f"h{i}") for i in range(4)])


@query("minhash_lsh_boilerplate", f"WITH {_CHUNKED}, {_THRESHOLD}, {_lsh_sql('ch')} SELECT md5(norm) AS norm_md5 FROM hot")
def minhash_lsh_boilerplate(spark, sf_dir):
    parts = corpus.chunks(_lines(spark, sf_dir))
    hot = corpus.hot_chunks(parts, corpus.document_threshold(A.table(spark, sf_dir, "documents").count()))
    return hot.select(F.md5(F.col("norm").cast("binary")).alias("norm_md5"))


_CLEANED = f"""WITH {_CHUNKED}, {_THRESHOLD}, {_EDGED},
fc AS (SELECT norm FROM ch GROUP BY norm HAVING count(DISTINCT doc_id) >= (SELECT t FROM th)),
m1 AS (SELECT ch.*, norm IN (SELECT norm FROM fe) AS e, norm IN (SELECT norm FROM fc) AS c FROM ch),
re AS (SELECT doc_id, norm FROM m1 WHERE NOT e AND NOT c),
{_lsh_sql('re')},
m2 AS (SELECT *, norm IN (SELECT norm FROM hot) AS h FROM m1)"""


@query("clean_corpus_stats", f"{_CLEANED} SELECT count(*) AS chunks, count(*) FILTER (WHERE e) AS dropped_edge, count(*) FILTER (WHERE NOT e AND c) AS dropped_frequent, count(*) FILTER (WHERE NOT e AND NOT c AND h) AS dropped_near, count(*) FILTER (WHERE NOT e AND NOT c AND NOT h) AS kept, CAST((SELECT count(*) FROM documents) AS INT) AS documents, CAST((SELECT t FROM th) AS INT) AS threshold FROM m2")
def clean_corpus_stats(spark, sf_dir):
    return corpus.clean_corpus(A.corpus_docs(spark, sf_dir))[1]


@query("clean_corpus_texts", f"{_CLEANED}, tx AS (SELECT doc_id, string_agg(raw, chr(10) || chr(10) ORDER BY ordinal) AS body FROM m2 WHERE NOT e AND NOT c AND NOT h GROUP BY doc_id) SELECT doc_id, md5(coalesce(regexp_replace(regexp_replace(regexp_replace(body, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_DSP}]+|[{_DSP}]+$', '', 'g'), '')) AS digest FROM cd LEFT JOIN tx USING (doc_id)")
def clean_corpus_texts(spark, sf_dir):
    """The cleaned texts themselves."""
    return corpus.clean_corpus(A.corpus_docs(spark, sf_dir))[0].select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- graph
_EDGES = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query("descendants", f"WITH RECURSIVE {_EDGES}, d AS (SELECT 'r1' AS root, 'r1' AS node UNION SELECT d.root, e.child FROM d JOIN e ON e.parent = d.node) SELECT root, node FROM d")
def descendants(spark, sf_dir):
    return graph.descendants(A.is_a(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"))


@query("ancestor_closure", f"WITH RECURSIVE {_EDGES}, a AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT a.node, e.parent FROM a JOIN e ON e.child = a.ancestor) SELECT node, ancestor FROM a")
def ancestor_closure(spark, sf_dir):
    return graph.ancestor_closure(A.is_a(spark, sf_dir))


_COHERENCE = f"WITH RECURSIVE {_EDGES}, a AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT a.node, e.parent FROM a JOIN e ON e.child = a.ancestor), s AS (SELECT node, ancestor FROM a UNION SELECT child, child FROM e), an AS (SELECT node, list(ancestor) AS anc FROM s GROUP BY node), cand AS (SELECT o_custkey AS q, 'c' || o_custkey AS node, 1 AS rank FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, 's' || (o_custkey % 10), 2 FROM orders GROUP BY o_custkey), j AS (SELECT x.q, len(list_intersect(ax.anc, ay.anc))::DOUBLE / len(list_distinct(ax.anc || ay.anc)) AS j, list_intersect(ax.anc, ay.anc) AS common FROM cand x JOIN cand y ON x.q = y.q AND x.rank = 1 AND y.rank = 2 JOIN an ax ON ax.node = x.node JOIN an ay ON ay.node = y.node), dep AS (SELECT node AS ancestor, count(*) + 1 AS depth FROM a GROUP BY node) SELECT q AS query_id, 2 AS n, round(j, 6) AS jaccard, 0.5::DOUBLE AS lineage, CAST(coalesce(list_max(list_transform(common, lambda c: CASE WHEN c[1] = 'r' THEN 1 ELSE 2 END)), 0) AS BIGINT) AS common_depth FROM j"


@query("coherence_features", _COHERENCE)
def coherence_features(spark, sf_dir):
    return graph.coherence(_candidates(spark, sf_dir), graph.ancestor_closure(A.is_a(spark, sf_dir)))


def _candidates(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select("o_custkey").distinct()
    cand = o.select(F.col("o_custkey").alias("query_id"), F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("s"), (F.col("o_custkey") % 10).cast("string")).alias("node")))).alias("x")).select("query_id", "x.*")
    return cand


def _reachability(spark, sf_dir):
    where = f"{shared_dir(spark)}/termloom/reachability-{uuid.uuid4().hex}"
    reachability.build_reachability(A.is_a(spark, sf_dir), where)
    return reachability.Reachability(spark, where)


@query("indexed_coherence", _COHERENCE)
def indexed_coherence(spark, sf_dir):
    """The same features by an index of intervals."""
    return graph.indexed_coherence(_candidates(spark, sf_dir), _reachability(spark, sf_dir))


@query("attribute_pivot", "WITH x AS (SELECT l_orderkey AS src, l_returnflag AS k, l_suppkey AS dst, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_suppkey) AS r FROM lineitem), n AS (SELECT src, k, s_name FROM x JOIN supplier ON s_suppkey = dst WHERE r = 1) SELECT src, max(CASE WHEN k = 'A' THEN s_name END) AS site, max(CASE WHEN k = 'N' THEN s_name END) AS method, max(CASE WHEN k = 'R' THEN s_name END) AS access FROM n GROUP BY src")
def attribute_pivot(spark, sf_dir):
    e = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type_id"), F.col("l_linenumber").alias("pos"))
    names = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("fsn"))
    return graph.attribute_targets(e, names, {"A": "site", "N": "method", "R": "access"})


@query("parents_capped", f"WITH {_EDGES} SELECT child AS node, array_to_string(list_sort(list(DISTINCT parent))[1:3], '|') AS parents FROM e GROUP BY child")
def parents_capped(spark, sf_dir):
    return graph.parents(A.is_a(spark, sf_dir), 3).select("node", F.array_join("parents", "|").alias("parents"))


_SCOPE = f"WITH RECURSIVE {_EDGES}, d AS (SELECT 'n3' AS node UNION SELECT 'n5' UNION SELECT e.child FROM d JOIN e ON e.parent = d.node) SELECT node FROM d WHERE node <> 'n5'"


@query("scope_expression", _SCOPE)
def scope_expression(spark, sf_dir):
    return graph.scope("<<n3 OR <n5", A.is_a(spark, sf_dir))


@query("indexed_scope", _SCOPE)
def indexed_scope(spark, sf_dir):
    """The same scope by an index of intervals."""
    return graph.scope("<<n3 OR <n5", _reachability(spark, sf_dir))


@query("tag_mismatch", "SELECT p_partkey AS id, p_brand AS found_tag, CASE WHEN p_size > 10 THEN p_type END AS tag, CASE WHEN coalesce(CASE WHEN p_size > 10 THEN p_type END, 'x') <> p_brand THEN 1 ELSE 0 END AS mismatch FROM part")
def tag_mismatch(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return graph.tag_mismatch(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("found_tag")), p.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("tag")))


@query("neighbour_counts", "SELECT x.s_suppkey AS concept, count(*) AS n FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey GROUP BY 1")
def neighbour_counts(spark, sf_dir):
    return graph.neighbour_counts(A.table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")


# ---------------------------------------------------------------- consistency and sampling
_SAMPLES = "s AS (SELECT user_id, event_id AS pos, CASE WHEN event_type = 'error' THEN 'ERROR: ' || event_id WHEN event_id % 2 = 0 THEN substring(event_type, 1, 2) || ' ' || substring(event_type, 3, 20) ELSE event_type END AS text FROM events)"


@query("group_candidates", f"WITH {_SAMPLES}, g AS (SELECT user_id, replace(text, ' ', '') AS norm, count(*) AS count, arg_min(text, pos) AS text, min(pos) AS f FROM s WHERE NOT starts_with(text, 'ERROR') GROUP BY 1, 2) SELECT user_id, CAST(sum(count) AS BIGINT) AS n_samples, count(*) AS n_distinct, arg_min(text, (-count, f)) AS top_candidate FROM g GROUP BY user_id")
def group_candidates(spark, sf_dir):
    return pairs.group_candidates(A.samples(spark, sf_dir), "user_id", "text").drop("candidates")


@query("majority_vote", f"WITH {_SAMPLES}, sp AS (SELECT user_id, replace(text, ' ', '') AS norm, text, count(*) AS n, min(pos) AS f FROM s GROUP BY 1, 2, 3), fo AS (SELECT user_id, norm, sum(n) AS total, min(f) AS ff, arg_max(text, (n, -f)) AS text FROM sp GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, ff) AS k FROM fo) SELECT user_id, text, CAST(total AS BIGINT) AS votes FROM r WHERE k = 1")
def majority_vote(spark, sf_dir):
    return pairs.majority_vote(A.samples(spark, sf_dir), "user_id", "text")


@query("tier_quota_sample", "SELECT doc_id, lang, CAST(draw AS INT) AS draw FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS draw FROM documents) WHERE draw <= CASE lang WHEN 'de' THEN 26 WHEN 'en' THEN 26 ELSE 25 END")
def tier_quota_sample(spark, sf_dir):
    return sampling.stratified(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", sampling.quotas(102, ["de", "en", "es", "fr"]), "42")


@query("split_train_holdout", "WITH d AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS draw FROM d), k AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM r WHERE draw <= 300) SELECT doc_id, lang, CAST(draw AS INT) AS draw, CASE WHEN draw <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'holdout' END AS split FROM k")
def split_train_holdout(spark, sf_dir):
    return sampling.split_holdout(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", "42", exclude=A.table(spark, sf_dir, "labels"))


@query("long_tail_strata", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'A' WHEN p_retailprice > 1500 THEN 'B' WHEN p_brand LIKE '%1' THEN 'C' WHEN p_type = 'PROMO' THEN 'D' ELSE 'E' END AS stratum FROM part")
def long_tail_strata(spark, sf_dir):
    s = sampling.first_stratum([("A", F.col("p_size") > 45), ("B", F.col("p_retailprice") > 1500), ("C", F.col("p_brand").like("%1")), ("D", F.col("p_type") == "PROMO")], "E")
    return A.table(spark, sf_dir, "part").select("p_partkey", s.alias("stratum"))


@query("spread_sample", "WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM x WHERE n <= 30 OR (i % greatest(1, n // 30) = 0 AND i // greatest(1, n // 30) < 30)")
def spread_sample(spark, sf_dir):
    return sampling.spread(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 30, by=["lang"])


@query("minimal_pairs", "WITH m AS (SELECT p_partkey, p_name, regexp_extract(p_name, '(red|green|blue|small|large)', 1) AS variant, regexp_replace(p_name, 'red|green|blue|small|large', '█', 'g') AS mask FROM part WHERE regexp_matches(p_name, 'red|green|blue|small|large')), o AS (SELECT *, row_number() OVER (PARTITION BY mask, variant ORDER BY p_partkey DESC) AS r FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY variant) AS v, count(*) OVER (PARTITION BY mask) AS n FROM o WHERE r = 1) SELECT mask, max(CASE WHEN v = 1 THEN variant END) AS variant_a, max(CASE WHEN v = 1 THEN p_name END) AS text_a, max(CASE WHEN v = 2 THEN variant END) AS variant_b, max(CASE WHEN v = 2 THEN p_name END) AS text_b FROM k WHERE n > 1 GROUP BY mask ORDER BY mask LIMIT 60")
def minimal_pairs(spark, sf_dir):
    return sampling.minimal_pairs(A.table(spark, sf_dir, "part"), "p_name", "red|green|blue|small|large", "p_partkey")


@query("blind_order", "SELECT conv_id, turn, contains('02468ace', right(md5(CAST(conv_id AS VARCHAR)), 1)) AS left_is_a FROM conversations")
def blind_order(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", sampling.blind_left(F.col("conv_id")).alias("left_is_a"))


@query("two_pass_order", "SELECT item_id, mode, CASE WHEN mode = 'primary' THEN c ELSE NOT c END AS left_is_a FROM (SELECT item_id, contains('02468ace', right(md5('5:' || item_id), 1)) AS c FROM benchmark), (SELECT unnest(['primary', 'swap']) AS mode)")
def two_pass_order(spark, sf_dir):
    return sampling.two_passes(A.table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "5")


@query("sequential_pools", "WITH a AS (SELECT doc_id, md5('3:' || doc_id) AS h FROM documents WHERE lang = 'fr' ORDER BY h, doc_id LIMIT 10), b AS (SELECT doc_id, md5('3:' || doc_id) AS h FROM documents WHERE n_chars < 500 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY h, doc_id LIMIT 20) SELECT doc_id, 'fr' AS pool FROM a UNION ALL SELECT doc_id, 'short' FROM b")
def sequential_pools(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return sampling.sequential_pools([("fr", d.where("lang = 'fr'"), 10), ("short", d.where("n_chars < 500"), 20)], "doc_id", "3")


@query("extremes", "SELECT * FROM (SELECT doc_id, n_chars, 'worst' AS \"end\" FROM documents ORDER BY n_chars, doc_id LIMIT 30) UNION ALL SELECT * FROM (SELECT doc_id, n_chars, 'best' AS \"end\" FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 10)")
def extremes(spark, sf_dir):
    return sampling.extremes(A.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("longest_notes", "WITH c AS (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations WHERE length(text) > 40) SELECT id, role, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY CASE WHEN contains(text, 'a') THEN 1 ELSE 0 END, length(text) DESC, id) AS place FROM c) WHERE place <= 6")
def longest_notes(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    return sampling.longest_notes(c, "role", "text", F.col("text").contains("a"), "id").select("id", "role", "place")


# ---------------------------------------------------------------- axes
@query("axis_site_usage", "WITH x AS (SELECT p_brand AS site, list_filter(['copper', 'brass', 'green', 'large', 'small', 'steel', 'blue', 'red', 'tin'], lambda f: contains(p_name, f))[1] AS form FROM part WHERE trim(p_brand) <> '') SELECT site, count(*) AS n, count(DISTINCT form) AS n_forms, array_to_string(list_sort(list(DISTINCT form) FILTER (WHERE form IS NOT NULL)), '|') AS forms FROM x GROUP BY site HAVING count(*) >= 2 AND count(DISTINCT form) >= 2")
def axis_site_usage(spark, sf_dir):
    return axes.site_usage(A.table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_name", _FORMS)


@query("axis_modality_variants", "WITH x AS (SELECT p_type, p_partkey, p_name, list_filter(['copper', 'brass', 'green', 'large', 'small', 'steel', 'blue', 'red', 'tin'], lambda f: contains(p_name, f))[1] AS form FROM part) SELECT p_type, count(*) AS n, count(DISTINCT form) AS n_variants, CAST(sum(CASE WHEN form IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, coalesce(array_to_string((list(p_name ORDER BY p_partkey) FILTER (WHERE form IS NOT NULL))[1:3], '|'), '') AS examples FROM x GROUP BY p_type HAVING count(DISTINCT form) >= 2 OR (count(DISTINCT form) >= 1 AND sum(CASE WHEN form IS NULL THEN 1 ELSE 0 END) > 0)")
def axis_modality_variants(spark, sf_dir):
    return axes.modality_variants(A.table(spark, sf_dir, "part"), "p_type", "p_name", _FORMS, "p_partkey")


@query("axis_terminal_suffix", "WITH x AS (SELECT p_type, CASE WHEN regexp_extract(p_name, '(olt|ate|et|ar|ing)$', 1) = '' THEN '_other' ELSE regexp_extract(p_name, '(olt|ate|et|ar|ing)$', 1) END AS suffix FROM part), p AS (SELECT p_type, suffix, count(*) AS n FROM x GROUP BY 1, 2) SELECT * FROM p WHERE p_type IN (SELECT p_type FROM p GROUP BY p_type HAVING count(*) >= 2)")
def axis_terminal_suffix(spark, sf_dir):
    return axes.terminal_suffixes(A.table(spark, sf_dir, "part"), "p_type", "p_name", ["et", "ate", "ar", "olt", "ing"])


@query("axis_contrast_order", "SELECT CASE WHEN regexp_matches(p_brand, '[13]$') THEN 'contrast_first' ELSE 'site_first' END AS ordering, count(*) AS n FROM part WHERE regexp_matches(p_name, 'red|green|blue|small|large') GROUP BY 1")
def axis_contrast_order(spark, sf_dir):
    return axes.contrast_order(A.table(spark, sf_dir, "part"), "p_name", "p_brand", "red|green|blue|small|large", "[13]$")


@query("error_patterns", "SELECT count(*) AS n, round(avg(CASE WHEN n_chars < 100 THEN 1.0::DOUBLE ELSE 0 END), 6) AS short_share, CASE WHEN avg(CASE WHEN n_chars < 100 THEN 1.0::DOUBLE ELSE 0 END) >= 0.2 THEN 1 ELSE 0 END AS short_problem, round(avg(CASE WHEN lang <> 'en' THEN 1.0::DOUBLE ELSE 0 END), 6) AS foreign_share, CASE WHEN avg(CASE WHEN lang <> 'en' THEN 1.0::DOUBLE ELSE 0 END) >= 0.15 THEN 1 ELSE 0 END AS foreign_problem FROM documents")
def error_patterns(spark, sf_dir):
    return axes.error_patterns(A.table(spark, sf_dir, "documents"), "n_chars", {"short": F.col("n_chars") < 100, "foreign": F.col("lang") != "en"}, {"short": 0.2, "foreign": 0.15})


# ---------------------------------------------------------------- flows, models, streams
@query("flow_evaluate", "SELECT count(*) AS n, 1.0::DOUBLE AS score FROM part WHERE p_partkey IS NOT NULL")
def flow_evaluate(spark, sf_dir):
    """A flow end to end: source, translation by an echoing model, evaluation, formula."""
    from .plans import flow, functions  # noqa: F401
    from .plans.roles import Dataset

    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("english"), F.col("p_name").alias("ko"))
    ctx = flow.Context(spark, sources={"terms": Dataset(p)}, models={"echo": lambda system, user: user.rsplit("\n", 1)[-1]}, guides={"g": "Repeat the term."})
    nodes = flow.load({"nodes": [{"id": "d", "type": "datasource", "params": {"source": "terms"}}, {"id": "g", "type": "style_guide", "params": {"guide": "g"}}, {"id": "t", "type": "translate_consistency", "params": {"model_key": "echo", "samples": 1}, "inputs": {"terms": "d", "style_guide": "g"}}, {"id": "e", "type": "evaluate_consistency", "params": {}, "inputs": {"candidates": "t", "reference": "d"}}, {"id": "f", "type": "evaluate_formula", "params": {"expression": "min(1, n / n)"}, "inputs": {"metrics": "e.metrics"}}]})
    done = flow.run(nodes, ctx)
    bad = [r.error for r in done.values() if not r.ok]
    if bad:
        raise RuntimeError(bad[0])
    return done["e"].outputs["metrics"].select("n", F.lit(done["f"].outputs["score"]).alias("score"))


@query("back_translate", "SELECT p_partkey AS id, upper(p_name) AS query FROM part WHERE trim(p_name) <> ''")
def back_translate(spark, sf_dir):
    from .operators import models

    return models.back_translate(A.table(spark, sf_dir, "part"), "p_partkey", "p_name", lambda system, user: f'"{user.upper()}."\nnote')


@query("windowed_event_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, sf_dir):
    from .streaming.metrics import windowed_counts

    return windowed_counts(A.table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _all() -> None:
    """The other modules register their queries when they are imported."""
    from importlib import import_module

    for name in ("source_queries", "text_queries", "model_queries"):
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
