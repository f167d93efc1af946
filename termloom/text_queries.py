"""Registered queries of the text functions, reply parsers and similarity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as A
from .functions import replies as R
from .functions import rules as H
from .functions import similarity as S
from .functions import text as T
from .operators import corpus, dictionary, graph, metrics, pairs, reports, sampling
from .plans.sql import register
from .queries import _BARE, _DBREAK, _DSP, _EDGES, _FORMS_SQL, _NOISE, _SAMPLES, query
from .sources import files as SRC


def _part(spark, sf_dir):
    return A.table(spark, sf_dir, "part")


@query("tag_variants", "SELECT p_partkey, p_name || ' (x)' AS last, p_name || ' (x)' AS ended, CASE WHEN p_size % 2 = 0 THEN p_name || ' (x)' ELSE p_name || ' (x) (' || p_type || ')' END AS listed, p_name || ' (' || p_type || ')' AS anywhere FROM part")
def tag_variants(spark, sf_dir):
    """A tag cut off in four ways: from the last one on, at the end, if it is listed, wherever it stands."""
    tag = F.when(F.col("p_size") % 2 == 0, "disorder").otherwise(F.col("p_type"))
    term = F.concat("p_name", F.lit(" (x) ("), tag, F.lit(")"))
    return _part(spark, sf_dir).select("p_partkey", T.strip_tag_last(term).alias("last"), T.strip_tag_end(term).alias("ended"), T.strip_tag_listed(term, ["finding", "disorder"]).alias("listed"), T.strip_tag_anywhere(F.concat("p_name", F.lit(" (x) ("), "p_type", F.lit(")")), "x").alias("anywhere"))


@query("light_normalize", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_DSP}]+|[{_DSP}]+$', '', 'g')) AS digest FROM (SELECT doc_id, '  ' || chr(13) || replace(text, chr(10), '  ' || chr(9) || chr(10) || chr(10) || chr(10)) AS t FROM documents)")
def light_normalize(spark, sf_dir):
    spread = F.concat(F.lit("  \r"), F.replace("text", F.lit("\n"), F.lit("  \t\n\n\n")))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.light_normalize(spread).cast("binary")).alias("digest"))


def _markdown():
    return F.concat(F.lit("# "), "p_type", F.lit("\n> quoted `"), "p_name", F.lit("` and [link "), "p_brand", F.lit("](http://x.y/z)\n- ![pic "), "p_type", F.lit("](a.png)\n```\ncode "), "p_name", F.lit("\n```\n| a | b |"))


@query("markdown_strip", "SELECT p_partkey, '# ' || p_type || chr(10) || '> quoted ' || p_name || ' and link ' || p_brand || chr(10) || '- pic ' || p_type || chr(10) || chr(10) || '| a | b |' AS stripped, p_type || chr(10) || 'quoted ' || p_name || ' and link ' || p_brand || chr(10) || 'pic ' || p_type || chr(10) || chr(10) || '  a   b  ' AS plain FROM part")
def markdown_strip(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", T.markdown_strip(_markdown()).alias("stripped"), T.markdown_plain(_markdown()).alias("plain"))


@query("html_strip", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def html_strip(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_strip(F.col("html")).cast("binary")).alias("digest"))


@query("header_lines", "SELECT p_partkey, p_size % 4 < 3 AS is_header, CAST(CASE WHEN p_size % 4 = 0 THEN p_size % 6 + 1 END AS INT) AS level, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_type ELSE '' END AS title FROM part")
def header_lines(spark, sf_dir):
    line = F.when(F.col("p_size") % 4 == 0, F.concat(F.repeat(F.lit("#"), (F.col("p_size") % 6 + 1).cast("int")), F.lit("  "), "p_name", F.lit(" "))).when(F.col("p_size") % 4 == 1, F.upper("p_name")).when(F.col("p_size") % 4 == 2, F.concat(F.lit(" "), "p_type")).otherwise(F.col("p_name"))
    h = T.header_of(line)
    return _part(spark, sf_dir).select("p_partkey", h["is_header"].alias("is_header"), h["level"].alias("level"), h["title"].alias("title"))


@query("marker_clean", f"SELECT doc_id, md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT ({_BARE} <> '' AND ({_NOISE}))), '')) AS digest FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM (SELECT doc_id, regexp_split_to_array(text || chr(10) || 'page 7 of 9' || chr(10) || 'tel ' || doc_id || ' 555-1234' || chr(10) || '-----' || chr(9), '{_DBREAK}') AS ls FROM documents)) GROUP BY doc_id")
def marker_clean(spark, sf_dir):
    text = F.concat("text", F.lit("\npage 7 of 9\ntel "), F.col("doc_id").cast("string"), F.lit(" 555-1234\n-----\t"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(T.marker_clean(text), F.lit("")).cast("binary")).alias("digest"))


_RULES = (H.HardRule("no-red", "no red", "red", penalty=0.3), H.HardRule("end", "no gear at the end", r"gear$", regex=True, penalty=0.2, freeze="gear stays gear"), H.HardRule("off", "not enforced", "ring", penalty=1.0, enforce=False, freeze="Keep brands"))


@query("rules_and_hints", "SELECT p_partkey, '## Do not change' || chr(10) || '- gear stays gear' || chr(10) || '- Keep brands' AS frozen, array_to_string(list_filter([CASE WHEN contains(p_name, 'red') THEN 'colour' END, CASE WHEN contains(p_name, 'ring') THEN 'round' END, CASE WHEN contains(p_name, 'blue') THEN 'colour' END], lambda x: x IS NOT NULL), '; ') AS hints, array_to_string(list_filter([CASE WHEN contains(p_name, 'red') THEN 'no-red: no red' END, CASE WHEN regexp_matches(p_name, 'gear$') THEN 'end: no gear at the end' END], lambda x: x IS NOT NULL), '; ') AS broken FROM part")
def rules_and_hints(spark, sf_dir):
    table = (("RED", "colour"), ("ring", "round"), ("blue", "colour"))
    return _part(spark, sf_dir).select("p_partkey", F.lit(H.frozen_block(_RULES)).alias("frozen"), F.array_join(H.hints(F.upper("p_name"), table), "; ").alias("hints"), F.array_join(H.violations(F.col("p_name"), _RULES), "; ").alias("broken"))


@query("style_rule_triggers", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'Say the colour last.' END, CASE WHEN contains(p_name, 'gear') THEN 'Keep it.' END], lambda x: x IS NOT NULL), '|') AS texts FROM part")
def style_rule_triggers(spark, sf_dir):
    rules = T.parse_trigger_rules("# Rules\n- **Red, blue**: Say the colour last.\ntext\n* **gear** Keep it.\n")
    return _part(spark, sf_dir).select("p_partkey", F.array_join(T.triggered(F.upper("p_name"), rules), "|").alias("texts"))


@query("guide_sections", f"""WITH {A.CORPUS_SQL}, g AS (SELECT doc_id, text || chr(10) || '# End' || chr(10) || 'again ' || doc_id AS text FROM cd),
p AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS place, unnest(ps) AS part FROM (SELECT doc_id, string_split(chr(10) || array_to_string(regexp_split_to_array(text, '{_DBREAK}'), chr(10)), chr(10) || '# ') AS ps FROM g)),
s AS (SELECT doc_id, place, regexp_replace(string_split(part, chr(10))[1], '^[{_DSP}]+|[{_DSP}]+$', '', 'g') AS title, regexp_replace(regexp_replace(part, '^[^\n]*', ''), '^[{_DSP}]+|[{_DSP}]+$', '', 'g') AS body FROM p WHERE place > 0)
SELECT doc_id, title, CAST(min(place) AS INT) AS place, md5(max_by(body, place)) AS digest FROM s GROUP BY doc_id, title""")
def guide_sections(spark, sf_dir):
    """Documents as guides: their first-level sections, one title twice."""
    d = A.corpus_docs(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n# End\nagain "), F.col("doc_id").cast("string")))
    return corpus.sections(d).select("doc_id", "title", "place", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("word_totals", "SELECT lang, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS pieces, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang")
def word_totals(spark, sf_dir):
    """Size of a corpus in pieces between spaces."""
    d = A.table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("lang").agg(F.sum(SRC.word_total(F.col("text"))).alias("pieces"), F.count("*").alias("n"))


@query("depth_histogram", f"WITH RECURSIVE {_EDGES}, c AS (SELECT child AS node, parent AS up FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON e.child = c.up) SELECT ancestors, count(*) AS n FROM (SELECT node, count(*) AS ancestors FROM c GROUP BY node) GROUP BY ancestors")
def depth_histogram(spark, sf_dir):
    """How many concepts have how many ancestors."""
    return graph.depth_histogram(graph.ancestor_closure(A.is_a(spark, sf_dir)))


@query("truncate_texts", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END) AS digest, length(text) > 500 AS cut FROM documents")
def truncate_texts(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate(F.col("text"), 500).cast("binary")).alias("digest"), (F.length("text") > 500).alias("cut"))


@query("prompt_blocks", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '(no examples)' ELSE '| English | Target |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| ' || p_type || ' | b |' END AS pairs, CASE WHEN p_size % 2 = 0 THEN 'Term:' || chr(10) || p_name || chr(10) || chr(10) ELSE '' END || 'Note:' || chr(10) || p_type AS context FROM part")
def prompt_blocks(spark, sf_dir):
    pair = lambda a, b: F.struct(a.alias("en"), b.alias("target"))
    some = F.array(pair(F.col("p_name"), F.col("p_brand")), pair(F.col("p_type"), F.lit("b")))
    none = F.array().cast("array<struct<en:string,target:string>>")
    return _part(spark, sf_dir).select("p_partkey", T.pair_table(F.when(F.col("p_size") % 3 == 0, none).otherwise(some)).alias("pairs"), T.context_sections([("Term:", F.when(F.col("p_size") % 2 == 0, F.col("p_name"))), ("Empty:", F.lit("")), ("Note:", F.col("p_type"))]).alias("context"))


@query("reply_parsers", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 2.0::DOUBLE END AS score, CASE p_size % 3 WHEN 0 THEN 'MINOR' WHEN 1 THEN 'MAJOR' END AS label, CAST(CASE p_size % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 END AS INT) AS confidence, CASE p_size % 3 WHEN 0 THEN 'tie' WHEN 1 THEN 'B' END AS verdict, CASE p_size % 3 WHEN 0 THEN '{"label": "minor", "confidence": "9"}' WHEN 1 THEN 'MAJOR confidence: 0' ELSE p_name END AS line FROM part""")
def reply_parsers(spark, sf_dir):
    k = F.col("p_size") % 3
    half = (F.col("p_size") / 2.0).cast("string")
    said = F.when(k == 0, 'thinking</think>\n\n{"label": "minor", "confidence": "9"}\nWINNER: tie').when(k == 1, F.concat(F.lit("MAJOR confidence: 0\nA then VERDICT: B\nSCORE: 3 or SCORE: "), half)).otherwise(F.concat("p_name", F.lit("\nmy last number is "), half))
    reply = F.concat(F.lit("<think>SCORE: 99 label MAJOR WINNER: A confidence: 3"), F.when(k == 0, "").otherwise("</think>"), said)
    scored = F.when(k == 0, F.lit("none at all")).otherwise(reply)
    line = F.when(k == 0, T.first_line(reply)).otherwise(R.first_line_bare(reply))
    return _part(spark, sf_dir).select("p_partkey", R.score(scored).alias("score"), R.label(reply, ["MINOR", "MAJOR"]).alias("label"), R.confidence(reply).alias("confidence"), R.verdict(reply).alias("verdict"), line.alias("line"))


@query("glossary_hits", "WITH k AS (SELECT p_partkey, ' ' || lower(p_name) || ' ' || lower(p_type) || ' ' AS t FROM part), h AS (SELECT p_partkey, unnest(['small widget', 'hot gear', 'gear', 'widget', 'red ring', 'ring', 'ring small', 'plate']) AS g, t FROM k), f AS (SELECT p_partkey, g FROM h WHERE length(g) >= 4 AND contains(t, ' ' || g || ' ')), m AS (SELECT a.p_partkey, a.g FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.p_partkey = a.p_partkey AND b.g <> a.g AND contains(b.g, a.g))) SELECT k.p_partkey, coalesce(string_agg(g, '|' ORDER BY length(g) DESC, g), '') AS hits FROM k LEFT JOIN m USING (p_partkey) GROUP BY k.p_partkey")
def glossary_hits(spark, sf_dir):
    keys = F.array(*[F.lit(x) for x in ("small widget", "hot gear", "gear", "widget", "red ring", "ring", "ring small", "plate")])
    return _part(spark, sf_dir).select("p_partkey", F.array_join(T.glossary_hits(F.concat_ws(" ", F.upper("p_name"), "p_type"), keys), "|").alias("hits"))


_PHRASES = """WITH w AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT g FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w UNION ALL SELECT unnest(w) FROM w UNION ALL SELECT p_name FROM part) WHERE length(g) >= 4),
t AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS t FROM documents)"""


def _phrases(spark, sf_dir):
    """Words, neighbouring words of the benchmark, and names of parts."""
    w = A.table(spark, sf_dir, "benchmark").select(F.split(T.normalize_key(F.col("text")), " ").alias("w"))
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat(x, F.lit(" "), F.element_at("w", (i + 2).cast("int"))))
    both = w.select(F.explode(F.concat("w", pairs)).alias("key"))
    return both.unionAll(_part(spark, sf_dir).select("p_name")).distinct()


@query("dictionary_phrases", f"""{_PHRASES}, h AS (SELECT doc_id, g FROM t JOIN k ON contains(t, ' ' || g || ' ')),
m AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY length(g) DESC, g) AS r FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.g <> a.g AND contains(b.g, a.g)))
SELECT documents.doc_id, CAST(coalesce(n, 0) AS INT) AS n_hits, coalesce(hits, '') AS hits FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(g, '|' ORDER BY r) AS hits FROM m WHERE r <= 6 GROUP BY doc_id) USING (doc_id)""")
def dictionary_phrases(spark, sf_dir):
    """Phrases of a dictionary table in whole documents."""
    texts = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dictionary.glossary_matches(texts, _phrases(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_hits", F.array_join("hits", "|").alias("hits"))


@query("dictionary_longest_form", "WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS g FROM benchmark), h AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY length(g) DESC, g) AS r FROM documents JOIN k ON contains(text, g)) SELECT documents.doc_id, g AS form FROM documents LEFT JOIN h ON h.doc_id = documents.doc_id AND r = 1")
def dictionary_longest_form(spark, sf_dir):
    """The longest word of the benchmark inside each document, wherever it stands."""
    forms = A.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("form"))
    texts = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dictionary.longest_forms(texts, forms).withColumnRenamed("id", "doc_id")


def chrf_sql(source: str, key: str = "id") -> str:
    """CTEs that end in ``chrf(key, chrf)`` of ``source(key, h, r)``, spaces removed already."""
    return f"""o AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n),
hg AS (SELECT {key}, n, substring(h, i, n) AS g, count(*) AS c FROM (SELECT {key}, h, n, unnest(range(1, greatest(length(h) - n + 2, 1))) AS i FROM {source}, o) GROUP BY 1, 2, 3),
rg AS (SELECT {key}, n, substring(r, i, n) AS g, count(*) AS c FROM (SELECT {key}, r, n, unnest(range(1, greatest(length(r) - n + 2, 1))) AS i FROM {source}, o) GROUP BY 1, 2, 3),
mg AS (SELECT {key}, n, sum(least(hg.c, rg.c)) AS same FROM hg JOIN rg USING ({key}, n, g) GROUP BY 1, 2),
kg AS (SELECT s.{key}, o.n, length(h) - o.n + 1 AS hn, length(r) - o.n + 1 AS rn FROM {source} s, o WHERE length(h) >= o.n AND length(r) >= o.n),
ag AS (SELECT kg.{key}, avg(coalesce(same, 0)::DOUBLE / hn) AS p, avg(coalesce(same, 0)::DOUBLE / rn) AS q FROM kg LEFT JOIN mg USING ({key}, n) GROUP BY 1),
chrf AS (SELECT s.{key}, coalesce(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) * 100 END, 0) AS chrf FROM {source} s LEFT JOIN ag USING ({key}))"""


@query("consistency_calibration", f"""WITH {_SAMPLES}, g AS (SELECT user_id, replace(text, ' ', '') AS norm, count(*) AS count, arg_min(text, pos) AS text, min(pos) AS f FROM s WHERE NOT starts_with(text, 'ERROR') GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY count DESC, f) AS i FROM g), ref AS (SELECT user_id, min(text) AS ref FROM s GROUP BY 1),
src AS (SELECT c.user_id || '-' || i AS id, c.user_id, i, replace(c.text, ' ', '') AS h, replace(ref, ' ', '') AS r FROM c JOIN ref USING (user_id)), {chrf_sql('src')},
e AS (SELECT user_id, i, round(chrf, 4) AS s FROM src JOIN chrf USING (id)), u AS (SELECT user_id, count(*) AS n, max(s) AS best, max(CASE WHEN i = 1 THEN s END) AS first FROM e GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE n > 1) AS n_multi_candidate, round(avg(first), 6) AS mean_chrf, round(coalesce(avg(CASE WHEN n > 1 THEN CASE WHEN first >= best - 1e-6 THEN 1 ELSE 0 END END), 0), 6) AS majority_oracle_accuracy FROM u""")
def consistency_calibration(spark, sf_dir):
    got = pairs.group_candidates(A.samples(spark, sf_dir), "user_id", "text")
    refs = A.samples(spark, sf_dir).groupBy("user_id").agg(F.array(F.min("text")).alias("refs"))
    return metrics.consistency_summary(metrics.consistency_scores(got, refs, "user_id"))


_SCORES = f"src AS (SELECT p_partkey AS id, p_name AS candidate, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type || ' ' || p_name END AS ref, replace(p_name, ' ', '') AS h, replace(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type || ' ' || p_name END, ' ', '') AS r, p_size FROM part), {chrf_sql('src')}"


def _scored(spark, sf_dir):
    ref = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    return _part(spark, sf_dir).select("p_partkey", "p_size", F.col("p_name").alias("candidate"), F.array(ref).alias("refs"))


@query("guided_metric", f"WITH {_SCORES}, v AS (SELECT h = r AS exact, chrf, CASE WHEN contains(candidate, 'red') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(candidate, 'gear$') THEN 0.2 ELSE 0 END AS penalty FROM src JOIN chrf USING (id)) SELECT count(*) AS n, round(avg(greatest(0.5::DOUBLE * exact::INT + 0.5::DOUBLE * chrf / 100 - CASE WHEN exact THEN 0 ELSE penalty::DOUBLE END, 0)), 6) AS score FROM v")
def guided_metric(spark, sf_dir):
    from .operators import models

    return models.guide_metric(_scored(spark, sf_dir), _RULES)


@query("hybrid_composite", f"WITH {_SCORES} SELECT id AS p_partkey, round(0.5::DOUBLE * chrf / 100 + 0.3::DOUBLE * (p_size / 50.0::DOUBLE) + 0.2::DOUBLE * (h = r)::INT, 5) AS score FROM src JOIN chrf USING (id)")
def hybrid_composite(spark, sf_dir):
    s = _scored(spark, sf_dir)
    best = S.best_chrf(F.col("candidate"), F.col("refs"))["chrf"]
    return s.select("p_partkey", F.round(S.hybrid_composite(S.exact_match(F.col("candidate"), F.col("refs")), best, F.col("p_size") / 50.0), 5).alias("score"))


@query("calibration_correlation", "SELECT p_type, count(*) AS n, round(corr(p_size % 5 + 1, p_retailprice), 6) AS pearson FROM part GROUP BY p_type")
def calibration_correlation(spark, sf_dir):
    p = _part(spark, sf_dir).select("p_type", (F.col("p_size") % 5 + 1).alias("level"), "p_retailprice")
    return metrics.calibration_correlation(p, "level", "p_retailprice", ["p_type"])


@query("confidence_routing", "WITH r AS (SELECT CASE WHEN p_size % 9 > 0 THEN p_size % 5 + 1 END AS l, p_retailprice AS v, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS e FROM part), c AS (SELECT unnest([1, 2, 3, 4, 5]) AS cutoff) SELECT CAST(cutoff AS INT) AS cutoff, count(*) FILTER (WHERE l >= cutoff) AS n_kept, round(avg(v) FILTER (WHERE l >= cutoff), 6) AS kept_mean, round(avg(e) FILTER (WHERE l >= cutoff), 6) AS kept_exact, count(*) FILTER (WHERE l IS NULL OR l < cutoff) AS n_routed, round(avg(v) FILTER (WHERE l IS NULL OR l < cutoff), 6) AS routed_mean FROM r, c GROUP BY cutoff")
def confidence_routing(spark, sf_dir):
    p = _part(spark, sf_dir).select(F.when(F.col("p_size") % 9 > 0, F.col("p_size") % 5 + 1).alias("l"), F.col("p_retailprice").alias("v"), (F.col("p_size") % 3 == 0).cast("int").alias("e"))
    return metrics.confidence_routing(p, "l", "v", "e")


@query("error_patterns_all", "WITH r AS (SELECT p_name, p_brand, p_size / 50.0::DOUBLE AS s FROM part) SELECT count(*) AS n, round(avg((contains(p_name, 'red') AND s < 0.6)::INT::DOUBLE), 6) AS a_share, CASE WHEN avg((contains(p_name, 'red') AND s < 0.6)::INT::DOUBLE) >= 0.2 THEN 1 ELSE 0 END AS a_problem, round(avg((length(p_name) > 8)::INT::DOUBLE), 6) AS b_share, CASE WHEN avg((length(p_name) > 8)::INT::DOUBLE) >= 0.2 THEN 1 ELSE 0 END AS b_problem, round(avg((right(p_brand, 1) = '1')::INT::DOUBLE), 6) AS c_share, CASE WHEN avg((right(p_brand, 1) = '1')::INT::DOUBLE) >= 0.15 THEN 1 ELSE 0 END AS c_problem, round(avg((s < 0.5)::INT::DOUBLE), 6) AS d_share, CASE WHEN avg((s < 0.5)::INT::DOUBLE) >= 0.4 THEN 1 ELSE 0 END AS d_problem FROM r")
def error_patterns_all(spark, sf_dir):
    """All four conditions with their bars of 20, 20, 15 and 40 per cent."""
    from .operators import axes

    p = _part(spark, sf_dir).withColumn("s", F.col("p_size") / 50.0)
    checks = {"a": F.col("p_name").contains("red") & (F.col("s") < 0.6), "b": F.length("p_name") > 8, "c": F.right("p_brand", F.lit(1)) == "1", "d": F.col("s") < 0.5}
    return axes.error_patterns(p, "s", checks, {"a": 0.2, "b": 0.2, "c": 0.15, "d": 0.4})


@query("hierarchy_means", "WITH h AS (SELECT CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS g, p_retailprice AS a, p_size AS b, regexp_matches(p_name, 'red|blue') AS native FROM part), n AS (SELECT CASE WHEN g = '' THEN '(no tag)' ELSE g END AS name, * FROM h), k AS (SELECT name AS nm, count(*) AS n FROM n GROUP BY 1) SELECT CASE WHEN k.n >= 10 THEN name ELSE '(other)' END AS name, native, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM n JOIN k ON k.nm = n.name GROUP BY 1, 2")
def hierarchy_means(spark, sf_dir):
    """Means of several scores by hierarchy, small ones together, split by the kind of word."""
    p = _part(spark, sf_dir).select(F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")).alias("g"), F.col("p_retailprice").alias("a"), F.col("p_size").alias("b"), F.col("p_name").rlike("red|blue").alias("native"))
    return reports.split_means(p, "g", 10, ["a", "b"], "native")


@query("hierarchy_map", "SELECT p_partkey, CASE WHEN p_size > 40 THEN '(unmapped)' WHEN p_size % 5 = 0 THEN '(no tag)' ELSE p_type END AS hierarchy FROM part")
def hierarchy_map(spark, sf_dir):
    """Results mapped to hierarchies: keys that the labels lack are unmapped, blank names have no tag."""
    p = _part(spark, sf_dir)
    labels = p.where("p_size <= 40").select("p_partkey", F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_type")).alias("hierarchy"))
    return metrics.with_hierarchy(p.select("p_partkey"), labels, "p_partkey").select("p_partkey", "hierarchy")


@query("diverse_by_bucket", "WITH a AS (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part), b AS (SELECT * FROM a WHERE size <= 5 OR (i % greatest(1, size // 5) = 0 AND i // greatest(1, size // 5) < 5)), c AS (SELECT *, row_number() OVER (ORDER BY size DESC, p_brand, p_partkey) - 1 AS j, count(*) OVER () AS n FROM b) SELECT p_partkey, p_brand FROM c WHERE n <= 40 OR (j % greatest(1, n // 40) = 0 AND j // greatest(1, n // 40) < 40)")
def diverse_by_bucket(spark, sf_dir):
    return sampling.diverse_by_bucket(_part(spark, sf_dir).select("p_partkey", "p_brand"), "p_brand", "p_partkey", 5, 40)


@query("length_ordered", "SELECT conv_id, turn, length(text) AS n, row_number() OVER (ORDER BY length(text), conv_id * 1000 + turn) AS place FROM conversations WHERE length(text) BETWEEN 1 AND 80")
def length_ordered(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return sampling.by_length(c, "text", "id").select("conv_id", "turn", F.length("text").cast("long").alias("n"), "place")


_CHUNKS = r"""WITH b AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM benchmark),
f AS (SELECT item_id, list_reduce(list_prepend({'o': []::VARCHAR[], 'w': []::VARCHAR[]}, list_transform(s, lambda x: {'o': []::VARCHAR[], 'w': [x]})), lambda a, x: CASE WHEN len(a.w) > 0 AND coalesce(list_sum(list_transform(a.w, lambda y: length(y) + 1)), 0) + length(x.w[1]) > 200
  THEN {'o': list_append(a.o, array_to_string(a.w, ' ')), 'w': list_concat(list_reverse(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_reverse(a.w), lambda y: [y])), lambda c, y: CASE WHEN coalesce(list_sum(list_transform(c, lambda z: length(z) + 1)), 0) + length(y[1]) + 1 <= 60 THEN list_concat(c, y) ELSE c END)), x.w)}
  ELSE {'o': a.o, 'w': list_concat(a.w, x.w)} END) AS r FROM b),
c AS (SELECT item_id, CASE WHEN len(r.w) > 0 THEN list_append(r.o, array_to_string(r.w, ' ')) ELSE r.o END AS cs FROM f)
SELECT item_id, CAST(generate_subscripts(cs, 1) - 1 AS INT) AS pos, unnest(cs) AS chunk FROM c"""


@query("sentence_chunks", _CHUNKS)
def sentence_chunks(spark, sf_dir):
    return A.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.sentence_chunks(F.col("text"), 200, 60)).alias("pos", "chunk"))


@query("sql_sentence_chunks", _CHUNKS)
def sql_sentence_chunks(spark, sf_dir):
    """The same chunks by a table function in SQL."""
    register(spark)
    A.table(spark, sf_dir, "benchmark").createOrReplaceTempView("termloom_benchmark")
    return spark.sql("SELECT item_id, c.pos, c.chunk FROM termloom_benchmark, LATERAL sentence_chunks(text, 200, 60) AS c")


@query("sql_surface_forms", _FORMS_SQL)
def sql_surface_forms(spark, sf_dir):
    """Surface forms by a table function in SQL."""
    register(spark)
    _part(spark, sf_dir).createOrReplaceTempView("termloom_part")
    return spark.sql("SELECT p_partkey AS sctid, fsn, f.pos, f.text FROM (SELECT p_partkey, p_name, p_brand, concat(p_name, ' (', p_type, ')') AS fsn FROM termloom_part), LATERAL surface_forms(fsn, array(p_name, fsn, p_brand)) AS f")


@query("chunk_shingles", "SELECT item_id, CAST(len(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE w END)) AS INT) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)")
def chunk_shingles(spark, sf_dir):
    return A.table(spark, sf_dir, "benchmark").select("item_id", F.size(corpus.shingles(F.col("text"))).alias("n"))
