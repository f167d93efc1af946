"""Registered queries of the model row operators, flows, indexes and concept contexts.

Models are deterministic callables, so that SQL can say what they answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as A
from .functions import replies as R
from .functions import text as T
from .operators import graph, models, pairs, retrieval
from .queries import query
from .sources import files as S
from .sources.tables import checkpointed


def _part(spark, sf_dir):
    return A.table(spark, sf_dir, "part")


def _terms(spark, sf_dir):
    return _part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("sctid"), F.col("p_name").alias("en"))


def _fussy(system: str, user: str) -> str:
    """Answers in upper case; one kind of term is refused."""
    if "anvil" in user:
        raise ValueError("no anvils")
    return f"{system}{user.upper()}"


@query("model_completions", "SELECT p_partkey, CASE WHEN contains(p_name, 'anvil') THEN 'ERROR: no anvils' ELSE '> ' || upper(p_name) END AS reply, NOT contains(p_name, 'anvil') AS ok FROM part")
def model_completions(spark, sf_dir):
    p = _part(spark, sf_dir).select("p_partkey", F.lit("> ").alias("system"), F.col("p_name").alias("user"))
    return models.complete(p, _fussy).select("p_partkey", "reply", "ok")


@query("translate_stage", "WITH k AS (SELECT CAST(p_partkey AS VARCHAR) AS sctid, p_name, p_brand FROM part WHERE p_size > 10) SELECT sctid, p_name AS en, CASE WHEN contains(p_name, 'anvil') THEN 'ERROR: no anvils' ELSE upper('Examples:') END AS target, NOT contains(p_name, 'anvil') AS ok FROM k")
def translate_stage(spark, sf_dir):
    """Terms with an exemplar table and a guide; those that are done are not asked again; the first line of a reply counts."""
    t = _terms(spark, sf_dir)
    done = _part(spark, sf_dir).where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("sctid"))
    shots = _part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("sctid"), F.col("p_type").alias("en"), F.col("p_brand").alias("target"), F.lit(1).alias("rank"))
    return models.translate(t, shots, "", _fussy, done)


def _sampled(system: str, user: str) -> str:
    term, _, n = user.partition("\n#")
    return f'"{term}{" x" if int(n) % 3 == 0 else ""}."'


@query("translate_samples", "SELECT CAST(p_partkey AS VARCHAR) AS sctid, p_name AS en, 4::BIGINT AS n_samples, 2::BIGINT AS n_distinct, p_name || '=3|' || p_name || ' x=1' AS candidates, p_name AS top_candidate FROM part")
def translate_samples(spark, sf_dir):
    got = models.translate_samples(_terms(spark, sf_dir), "guide", _sampled, 4)
    shown = F.array_join(F.transform("candidates", lambda x: F.concat(x["text"], F.lit("="), x["count"].cast("string"))), "|")
    return got.withColumn("candidates", shown)


def _judge(system: str, user: str) -> str:
    return "<think>BEST: 1</think>BEST: 2\nREASON: it is second" if "red" in user else "cannot say"


@query("judge_candidates", "SELECT CAST(p_partkey AS VARCHAR) AS sctid, CASE WHEN p_size % 2 = 0 THEN p_name WHEN contains(p_name, 'red') THEN p_name || ' b' ELSE p_name || ' a' END AS target, CASE WHEN p_size % 2 = 1 AND contains(p_name, 'red') THEN 1 ELSE 0 END AS judged, CASE WHEN p_size % 2 = 1 AND contains(p_name, 'red') THEN 'it is second' ELSE '' END AS reason FROM part")
def judge_candidates(spark, sf_dir):
    one = lambda x: F.struct(x.alias("text"), F.lit(1).cast("long").alias("count"))
    listed = F.when(F.col("p_size") % 2 == 0, F.array(one(F.col("p_name")))).otherwise(F.array(one(F.concat("p_name", F.lit(" a"))), one(F.concat("p_name", F.lit(" b")))))
    return models.judge_candidates(_part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("sctid"), listed.alias("candidates")), _judge)


def _labeller(system: str, user: str) -> str:
    return f'{{"label": "{"minor" if "red" in user else "major"}", "confidence": "{len(user)}"}}\nWINNER: {"A" if "ring" in user else "tie"}'


@query("judge_labels", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'MINOR' ELSE 'MAJOR' END AS label, CAST(least(length(p_name), 5) AS INT) AS confidence, CASE WHEN contains(p_name, 'ring') THEN 'A' ELSE 'tie' END AS winner, true AS ok FROM part")
def judge_labels(spark, sf_dir):
    parse = {"label": lambda c: R.label(c, ["MINOR", "MAJOR"]), "confidence": R.confidence, "winner": R.verdict}
    return models.judge_rows(_part(spark, sf_dir).select("p_partkey", "p_name"), F.col("p_name"), "judge", _labeller, parse).drop("p_name")


def _scorer(system: str, user: str) -> str:
    return f"<think>7</think>I see {user.count(chr(10)) + 1} metrics. SCORE: 3\nSCORE: {len(user)}"


@query("score_by_model", "SELECT CAST(length('Score' || chr(10) || 'a: 1' || chr(10) || 'n: ' || count(*)) AS DOUBLE) AS score FROM part")
def score_by_model(spark, sf_dir):
    n = _part(spark, sf_dir).count()
    return spark.createDataFrame([(models.score_metrics(_scorer, "Score\n{{metrics}}", {"n": float(n), "a": 1.0}),)], "score double")


@query("generate_text", "SELECT 'T ' || left(string_agg(r_name, ',' ORDER BY r_regionkey), 20) || chr(10) || '…[truncated]' || ' / x' AS text FROM region")
def generate_text(spark, sf_dir):
    names = ",".join(r["r_name"] for r in A.table(spark, sf_dir, "region").orderBy("r_regionkey").collect())  # five rows
    return spark.createDataFrame([(models.generate(lambda system, user: user, {"rows": names, "note": "x"}, "T {{ rows }} / {{note}}", most=20),)], "text string")


@query("mt_cache", "SELECT CAST(p_partkey AS VARCHAR) || '_et' AS key, CASE WHEN p_size < 25 THEN 'cached ' || p_brand ELSE 'et' || upper(p_name) END AS target FROM part WHERE NOT contains(p_name, 'anvil')")
def mt_cache(spark, sf_dir):
    p = _part(spark, sf_dir).where("not contains(p_name, 'anvil')")
    rows = p.select(F.col("p_partkey").cast("string").alias("sctid"), F.col("p_name").alias("en"))
    cache = p.where("p_size < 25").select(F.concat(F.col("p_partkey").cast("string"), F.lit("_et")).alias("key"), F.concat(F.lit("cached "), "p_brand").alias("target"))
    return models.cached_translations(rows, cache, "et", _fussy)


_RULE_WORDS = "w AS (SELECT string_split(p_name, ' ')[1] AS rule, p_partkey % 2 = 0 AS train FROM part), c AS (SELECT rule, count(*) AS n, count(*) FILTER (WHERE NOT train)::DOUBLE / (SELECT count(*) FROM w WHERE NOT train) AS hold FROM w GROUP BY rule)"


@query("optimise_rules", f"WITH {_RULE_WORDS} SELECT CAST(row_number() OVER (ORDER BY n DESC, rule) - 1 AS INT) AS pos, rule, round(sum(hold) OVER (ORDER BY n DESC, rule), 6) AS holdout FROM c")
def optimise_rules(spark, sf_dir):
    """Rules are first words of part names, the most frequent first, and words that no name has; a score is the share of names that a list covers, of half the parts each."""
    first = F.substring_index("p_name", " ", 1)
    parts = _part(spark, sf_dir).select(first.alias("word"), (F.col("p_partkey") % 2 == 0).alias("train"))
    words = [r["word"] for r in parts.groupBy("word").count().orderBy(F.desc("count"), "word").collect()]  # the few first words
    offers = iter([x for w in words for x in (w, w + "zz")])

    def score(kept):
        hit = F.col("word").isin(kept).cast("double") if kept else F.lit(0.0)
        r = parts.agg(F.avg(F.when(F.col("train"), hit)).alias("a"), F.avg(F.when(~F.col("train"), hit)).alias("b")).first()
        return r["a"], r["b"]

    kept, history = models.optimise_rules([], lambda rules, step: next(offers, None), score)
    taken = [h for h in history if h.get("accepted") and h["rule"] in kept]
    return spark.createDataFrame([(i, h["rule"], round(h["holdout"], 6)) for i, h in enumerate(taken)], "pos int, rule string, holdout double")


@query("optimise_guide", "WITH t AS (SELECT p_type, count(*)::DOUBLE / (SELECT count(*) FROM part) AS share, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_type) SELECT 'seed ' || string_agg(p_type, ' ' ORDER BY r) AS guide, 0.0::DOUBLE AS before, round(sum(share), 6) AS after FROM t WHERE r <= 3")
def optimise_guide(spark, sf_dir):
    """A guide grows by a type of part a round; a part is right if the guide names its type."""
    parts = _part(spark, sf_dir)
    types = iter([r["p_type"] for r in parts.groupBy("p_type").count().orderBy(F.desc("count"), "p_type").collect()])  # the few types

    def score(guide):
        outputs = parts.select(F.when(F.lit(guide).contains(F.col("p_type")), F.col("p_name")).otherwise("").alias("candidate"), "p_name")
        return outputs.agg(F.avg((F.col("candidate") == F.col("p_name")).cast("double")).alias("x")).first()["x"]

    guide, scores = models.optimise_guide("seed", lambda g, s: f"{g} {next(types)}", score, rounds=3)
    return spark.createDataFrame([(guide, round(scores["before"], 6), round(scores["after"], 6))], "guide string, before double, after double")


def _critic(system: str, user: str) -> str:
    return "ok, good" if user.split("\n")[1].count("!") >= len(user.split("\n")[0]) % 3 else "not yet"


def _drafter(system: str, user: str) -> str:
    lines = user.split("\n")
    return lines[0] if system == "draft" else f"{lines[1]}!"


@query("reflective_agent", "SELECT CAST(p_partkey AS VARCHAR) AS sctid, p_name AS en, p_name || repeat('!', CAST(length(p_name) % 3 AS INT)) AS target, CAST(length(p_name) % 3 AS INT) AS steps FROM part")
def reflective_agent(spark, sf_dir):
    """Drafts are revised until the critic says OK, only the open ones go on."""
    enrich = lambda d: d.withColumn("context", F.lit("c"))
    return models.reflective_agent(_terms(spark, sf_dir), _drafter, _critic, enrich)


@query("sampling_sweep", "SELECT 'a' AS config, count(*) AS n, 100.0::DOUBLE AS exact_match_pct, 100.0::DOUBLE AS mean_chrf, 1.0::DOUBLE AS composite_score FROM part UNION ALL SELECT 'b', count(*), 0.0, 0.0, 0.0 FROM part")
def sampling_sweep(spark, sf_dir):
    answers = {"a": lambda system, user: user.split("\n#")[0], "b": lambda system, user: "0"}
    refs = _terms(spark, sf_dir).select("sctid", F.lit(0).alias("pos"), F.array("en").alias("refs"))
    out = models.sampling_sweep(_terms(spark, sf_dir), [{"name": "a"}, {"name": "b"}], lambda c: answers[c["name"]], refs, samples=2)
    return out.select("config", "n", "exact_match_pct", "mean_chrf", "composite_score")


def _letters(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow: counts of some letters."""
    return [[float(t.count(x)) for x in "aeirgl"] for t in texts]


_EMBED = "list_transform(['a', 'e', 'i', 'r', 'g', 'l'], lambda x: CAST(length({0}) - length(replace({0}, x, '')) AS DOUBLE))"


@query("embed_documents", f"SELECT p_partkey AS id, array_to_string(list_transform({_EMBED.format('p_name')}, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS vector FROM part")
def embed_documents(spark, sf_dir):
    v = models.embed(_part(spark, sf_dir), "p_partkey", "p_name", _letters)
    return v.select("id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("concept_index_search", f"""WITH c AS (SELECT DISTINCT p_name AS text, {_EMBED.format('p_name')} AS e FROM part), q AS (SELECT p_partkey AS query_id, {_EMBED.format("p_name || ' old'")} AS e FROM part WHERE p_partkey % 20 = 0), s AS (SELECT query_id, text, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM q, c) SELECT query_id, max(score) AS best, count(*) FILTER (WHERE score >= 0.9) AS near FROM s GROUP BY query_id""")
def concept_index_search(spark, sf_dir):
    """An index of distinct texts with vectors, searched whole for a stated query set."""
    names = _part(spark, sf_dir).select("p_name").distinct()
    points = models.embed(names.withColumn("id", F.xxhash64("p_name")), "id", "p_name", _letters).withColumnRenamed("id", "point_id")
    q = models.embed(_part(spark, sf_dir).where("p_partkey % 20 = 0").select(F.col("p_partkey").cast("long").alias("id"), F.concat("p_name", F.lit(" old")).alias("t")), "id", "t", _letters).withColumnRenamed("id", "query_id")
    hits = retrieval.dense_topk(checkpointed(points, "points"), q, 64, self_match=True)
    return hits.groupBy("query_id").agg(F.max("score").alias("best"), F.sum((F.col("score") >= 0.9).cast("long")).alias("near"))


@query("paired_lookup_by_direction", """WITH p AS (SELECT 2 * p_partkey - 1 AS id, 'en-target' AS direction, p_name AS text FROM part UNION ALL SELECT 2 * p_partkey, 'target-en', p_brand FROM part), t AS (SELECT id, direction, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1)) AS token FROM p), w AS (SELECT id, direction, token, count(*) AS weight FROM t GROUP BY ALL), q AS (SELECT DISTINCT p_type AS query, 'red gear' AS text FROM part UNION ALL SELECT 'x', 'brand'), qt AS (SELECT query, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1)) AS token FROM q), s AS (SELECT query, id, sum(weight)::DOUBLE AS score FROM qt JOIN w USING (token) WHERE direction = 'en-target' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query AS query_id, id AS point_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def paired_lookup_by_direction(spark, sf_dir):
    """Index rows of both directions; the lookup takes one of them before ranking."""
    rows = retrieval.bidirectional_rows(A.pairs(spark, sf_dir)).where("direction = 'en-target'")
    p = _part(spark, sf_dir).select(F.col("p_type").alias("id"), F.lit("red gear").alias("text")).distinct().unionByName(spark.createDataFrame([("x", "brand")], "id string, text string"))
    return retrieval.sparse_topk(retrieval.lexical_weights(rows, "id", "text"), retrieval.lexical_weights(p, "id", "text"), 5)


@query("corpus_lookup", """WITH c AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), t AS (SELECT doc_id, token, count(*) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1)) AS token FROM c) GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, token) AS r FROM t) WHERE r <= 512), q AS (SELECT item_id, token, count(*) AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1)) AS token FROM benchmark) GROUP BY 1, 2), s AS (SELECT item_id, k.doc_id, CAST(sum(q.w * k.w) AS DOUBLE) AS score FROM q JOIN k USING (token) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, s.doc_id) AS rank FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM r WHERE rank <= 8 AND score >= 30) SELECT item_id AS query_id, f.doc_id AS point_id, score, CAST(rank AS INT) AS rank, CASE WHEN length(c.text) > 120 THEN left(c.text, 120) || '…' ELSE c.text END AS text FROM f JOIN c ON c.doc_id = f.doc_id WHERE n <= 3""")
def corpus_lookup(spark, sf_dir):
    """Passages of one language above a score, cut to a length."""
    d = A.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")
    q = A.table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = retrieval.sparse_topk(retrieval.lexical_weights(d, "doc_id", "text"), retrieval.lexical_weights(q, "item_id", "text"), 8)
    named = hits.join(d.withColumnRenamed("doc_id", "point_id"), "point_id")
    return retrieval.threshold_passages(named, 30, 3, 120).select("query_id", "point_id", "score", "rank", "text")


_GRAPH = "g AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey + 1000000 AS VARCHAR) AS id, p_name || ' (' || p_type || ')' AS fsn, p_size FROM part WHERE p_size % 10 <> 0)"


@query("concept_context", f"WITH {_GRAPH}, e AS (SELECT a.id, a.k, b.fsn FROM g a JOIN g b ON b.k = a.k % 50) SELECT g.id AS sctid, g.fsn, CASE WHEN k % 3 <> 0 THEN coalesce((SELECT any_value(fsn) FROM e WHERE e.id = g.id), '') ELSE '' END AS parents, CASE WHEN k % 3 = 0 THEN coalesce('site: ' || (SELECT any_value(fsn) FROM e WHERE e.id = g.id), '') ELSE '' END AS related FROM g")
def concept_context(spark, sf_dir):
    """Names, parents and attributes of every concept of a release."""
    root = A.release(spark, sf_dir)
    read = lambda pattern, columns: S.read_tsv(spark, S.find_release_file(spark, root, pattern), columns)
    d = read("sct2_Description_*.txt", S.DESCRIPTION_COLUMNS).withColumn("pos", F.col("id").cast("long"))
    nodes = S.concept_terms(read("sct2_Concept_*.txt", S.CONCEPT_COLUMNS), d).select("sctid", "fsn", "synonyms")
    e = read("sct2_Relationship_*.txt", S.RELATIONSHIP_COLUMNS).where("active = '1'").select(F.col("sourceId").alias("src"), F.col("destinationId").alias("dst"), F.col("typeId").alias("type_id"))
    out = graph.concept_context(nodes, e, S.IS_A, {"7": "site"})
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return out.select("sctid", "fsn", text("parents").alias("parents"), text("related").alias("related"))


@query("graph_info_join", f"WITH {_GRAPH}, r AS (SELECT CAST(p_partkey + 1000000 AS VARCHAR) AS id, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_brand END AS target FROM part) SELECT count(*) AS n, count(*) FILTER (WHERE trim(target) = '') AS blank, count(*) FILTER (WHERE trim(target) <> '' AND g.id IS NULL) AS missing, count(*) FILTER (WHERE trim(target) <> '' AND g.id IS NOT NULL) AS joined FROM r LEFT JOIN g USING (id)")
def graph_info_join(spark, sf_dir):
    """Rows with a target joined with what the release knows of them; what is missing is counted."""
    root = A.release(spark, sf_dir)
    info = S.active_concepts(S.read_tsv(spark, S.find_release_file(spark, root, "sct2_Concept_*.txt"), S.CONCEPT_COLUMNS)).withColumnRenamed("id", "sctid").withColumn("depth", F.lit(1))
    rows = _part(spark, sf_dir).select((F.col("p_partkey") + 1000000).cast("string").alias("sctid"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_brand")).alias("target"))
    return pairs.info_counts(rows, info, "sctid", "target")


@query("scope_refinement", "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), d AS (SELECT 'r1' AS root, 'r1' AS node UNION SELECT 'r2', 'r2' UNION SELECT d.root, e.child FROM d JOIN e ON e.parent = d.node) SELECT d.node FROM d JOIN supplier ON d.node = 's' || s_suppkey WHERE s_suppkey % 2 = 0 AND 's' || s_suppkey <> 's12' AND s_suppkey % 7 < 4")
def scope_refinement(spark, sf_dir):
    """Parentheses, exclusion and a refinement by a value that is an expression itself."""
    s = A.table(spark, sf_dir, "supplier")
    node = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    have = s.where("s_suppkey % 2 = 0").select(node.alias("src"), F.concat(F.lit("w"), (F.col("s_suppkey") % 7).cast("string")).alias("dst"), F.lit("site").alias("type_id"))
    values = spark.createDataFrame([(f"w{i}", "low") for i in range(4)], "child string, parent string")
    edges = A.is_a(spark, sf_dir).where("child not like 'c%'").unionByName(values)
    return graph.scope("((<<r1 |first| OR <<r2) MINUS s12): site = <<low, site = *", edges, have)


@query("assembled_flow", "SELECT count(*) FILTER (WHERE p_size > 5) AS n, 200.0::DOUBLE AS score, 'score' AS overridden, true AS same FROM part")
def assembled_flow(spark, sf_dir):
    """A flow from an environment's files: only the named sources are read, parameters are overridden, an older shape and its lifted form give the same nodes."""
    import uuid

    from .plans import config, flow, functions  # noqa: F401
    from .sources.tables import shared_dir

    where = f"{shared_dir(spark)}/termloom/env-{uuid.uuid4().hex}"
    p = _part(spark, sf_dir).where("p_size > 5").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("english"), F.col("p_name").alias("ko"))
    S.write_csv(p, f"{where}/terms")
    env = {"sources": {"terms": {"kind": "csv", "path": f"{where}/terms", "columns": ["id", "english", "ko"]}, "other": {"kind": "csv", "path": f"{where}/absent"}}, "guides": {"g": "Repeat."}}
    nodes = [{"id": "d", "type": "datasource", "params": {"source": "terms"}}, {"id": "g", "type": "style_guide", "params": {"guide": "g"}}, {"id": "t", "type": "translate_consistency", "params": {"model_key": "none", "samples": 1}, "inputs": {"terms": "d", "style_guide": "g"}}, {"id": "e", "type": "evaluate_consistency", "params": {}, "inputs": {"candidates": "t", "reference": "d"}}, {"id": "f", "type": "evaluate_formula", "params": {"expression": "exact_match_pct"}, "inputs": {"metrics": "e"}}]
    changed = config.override({"nodes": nodes}, {"t.model_key": "echo", "expression": "exact_match_pct * 2"})
    lifted = [{"id": n["id"], "type": "function", "params": {"function": n["type"]} | n["params"], "inputs": {k: {"node": v} for k, v in n.get("inputs", {}).items()}} for n in changed["nodes"]]
    models_ = {"echo": lambda system, user: user.split("\n")[0]}
    old, ctx = config.assemble(spark, changed, env, models_)
    new, _ = config.assemble(spark, {"nodes": lifted}, env, models_)
    done = flow.run(new, ctx)
    bad = [r.error for r in done.values() if not r.ok]
    if bad:
        raise RuntimeError(bad[0])
    same = [(n.id, n.function, n.params, n.inputs) for n in old] == [(n.id, n.function, n.params, n.inputs) for n in new] and list(ctx.sources) == ["terms"]
    return done["e"].outputs["metrics"].select("n", F.lit(float(done["f"].outputs["score"])).alias("score"), F.lit("score").alias("overridden"), F.lit(same).alias("same"))
