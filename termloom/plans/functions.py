"""The registered functions of flows, each a runner over lazy DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import metrics as M
from ..operators import models, retrieval
from ..operators.pairs import last_wins
from ..sources.positions import POSITION, with_position
from .flow import Context, Function, Param, Port, metric_vector, register
from .roles import Dataset

TERMS, PAIRS = ("sctid", "en"), ("en", "target")


def _model(ctx: Context, params: dict[str, Any], key: str = "model_key"):
    name = params.get(key)
    if name not in ctx.models:
        raise ValueError(f"unknown model: {name}")
    return ctx.models[name]


def _rows(value: Dataset | DataFrame) -> DataFrame:
    return value.select_roles() if isinstance(value, Dataset) else value


def _placed(value: Dataset | DataFrame) -> DataFrame:
    """Rows with their place in the file."""
    return value.select_positioned() if isinstance(value, Dataset) else with_position(value)


def _limited(value: Dataset | DataFrame, params: dict[str, Any]) -> DataFrame:
    """The first rows by their place, if there is a limit."""
    rows = _placed(value)
    return rows.orderBy(POSITION).limit(int(params["limit"])) if params.get("limit") else rows


def _exemplars(terms: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """Nearest pairs of each term by shared words."""
    table = pairs.select(F.xxhash64("en", "target").alias("id"), "en", "target").dropDuplicates(["id"])
    hits = retrieval.exemplar_lookup(terms.select(F.col("sctid").alias("query_id"), F.col("en").alias("text")), retrieval.lexical_weights(table, "id", "en"), n)
    return hits.join(table.withColumnRenamed("id", "point_id"), "point_id").select(F.col("query_id").alias("sctid"), "en", "target", "rank")


def datasource(inputs, params, ctx):
    return {"dataset": ctx.sources[params["source"]]}


def style_guide(inputs, params, ctx):
    return {"style_guide": ctx.guides[params["guide"]]}


def translate(inputs, params, ctx):
    terms = _limited(inputs["terms"], params)
    out = models.translate(terms, _exemplars(terms, _rows(inputs["exemplars"])), inputs["style_guide"], _model(ctx, params), ctx.extras.get("done"))
    return {"translations": out}


def translate_consistency(inputs, params, ctx):
    terms = _limited(inputs["terms"], params)
    return {"candidates": models.translate_samples(terms, inputs["style_guide"], _model(ctx, params), int(params["samples"]))}


def _references(value: Dataset | DataFrame) -> DataFrame:
    return _placed(value).select("sctid", F.col(POSITION).alias("pos"), M.split_references(F.col("target")).alias("refs"))


def _first_keys(rows: DataFrame, references: DataFrame, params: dict[str, Any]) -> DataFrame:
    """Rows of the first keys by their first place among the references, of those that have rows at all."""
    if not params.get("limit"):
        return rows
    firsts = references.groupBy("sctid").agg(F.min("pos").alias("first")).join(rows.select("sctid").distinct(), "sctid", "left_semi")
    return rows.join(firsts.orderBy("first").limit(int(params["limit"])), "sctid", "left_semi")


def evaluate(inputs, params, ctx):
    refs = _references(inputs["reference"])
    rows = _placed(inputs["translations"]).select("sctid", F.col(POSITION).alias("pos"), F.col("target").alias("candidate"))
    scored = M.score_rows(_first_keys(rows, refs, params), refs)
    return {"rows": scored, "metrics": M.composite_metrics(scored)}


def evaluate_consistency(inputs, params, ctx):
    got = _limited(inputs["candidates"], params)
    refs = _references(inputs["reference"])
    got, last = last_wins(got, "sctid", POSITION), last_wins(refs, "sctid")  # one row a key from here on
    chosen = models.judge_candidates(got, _model(ctx, params)) if params.get("model_key") else got.select("sctid", F.col("candidates")[0]["text"].alias("target"), F.lit(0).alias("judged"))
    scored = M.score_rows(chosen.select("sctid", F.lit(0).alias("pos"), F.col("target").alias("candidate")), last)
    summary = M.consistency_summary(M.consistency_scores(got, last.select("sctid", "refs"), "sctid"))
    judged = chosen.agg(F.sum("judged").alias("n_judged"))
    metrics = M.composite_metrics(scored).crossJoin(F.broadcast(summary.drop("n", "mean_chrf"))).crossJoin(F.broadcast(judged))  # one row each
    return {"rows": scored.join(chosen.select("sctid", "judged"), "sctid"), "metrics": metrics}


def optimize(inputs, params, ctx):
    train = _limited(inputs["trainset"], {"limit": params.get("train_limit")})
    dev = inputs.get("devset")
    held = _limited(dev, {"limit": params.get("dev_limit")}) if dev is not None else train
    model, reflect = _model(ctx, params), _model(ctx, params, "reflection_model_key")
    hard = ctx.extras.get("hard_rules", [])

    def score(guide: str) -> float:
        got = models.translate(held.select("sctid", "en"), None, guide, model).join(held.select("sctid", M.split_references(F.col("target")).alias("refs")), "sctid")
        return float(models.guide_metric(got.select(F.col("target").alias("candidate"), "refs"), hard).first()["score"])

    guide, scores = models.optimise_guide(inputs.get("seed_style_guide") or "", lambda g, s: reflect(g, f"{s:.6f}"), score, int(params["rounds"]))
    return {"optimized_style_guide": guide, "scores": scores}


def evaluate_formula(inputs, params, ctx):
    vector = metric_vector(inputs["metrics"])
    value = rules.evaluate_formula(params["expression"], vector | {f"metrics.{k}": v for k, v in vector.items()})
    return {"score": value}


def score_workflow_llm(inputs, params, ctx):
    return {"score": models.score_metrics(_model(ctx, params), params["prompt"], metric_vector(inputs["metrics"]))}


def generate_text(inputs, params, ctx):
    context = {}
    for port, v in inputs.items():
        context[port] = v if isinstance(v, str) else "\n".join(r["value"] for r in _rows(v).select(F.to_json(F.struct("*")).alias("value")).limit(int(params["rows"])).collect())
    return {"text": models.generate(_model(ctx, params), context, params["prompt"])}


def build_index(inputs, params, ctx):
    rows = _rows(inputs["concepts"])
    concepts = rows.select("sctid", F.col("en").alias("fsn"), (F.col("synonyms") if "synonyms" in rows.columns else F.array().cast("array<string>")).alias("synonyms"))
    forms = retrieval.surface_forms(concepts).withColumn("point_id", F.xxhash64("sctid", "text"))
    dense = models.embed(forms, "point_id", "text", ctx.models.get("embedder", models.hashing_embedder)).withColumnRenamed("id", "point_id")
    return {"index": {"points": forms, "dense": dense, "sparse": retrieval.lexical_weights(forms, "point_id", "text")}}


def _retrieved(inputs, params, ctx, depth: int) -> tuple[DataFrame, DataFrame]:
    index = inputs["index"]
    q = _rows(inputs["queries"])
    name = params["query_col"] if params["query_col"] in q.columns else "en"
    q = q.select(F.xxhash64(F.col(params["id_col"])).alias("query_id"), F.col(params["id_col"]).cast("string").alias("gold"), F.col(name).alias("query")).where(F.trim("query") != "")
    wide = 4 * depth
    found = []
    if params["mode"] in ("dense", "hybrid"):
        vec = models.embed(q, "query_id", "query", ctx.models.get("embedder", models.hashing_embedder)).withColumnRenamed("id", "query_id")
        found.append(retrieval.dense_topk(index["dense"], vec, wide))
    if params["mode"] in ("sparse", "hybrid"):
        found.append(retrieval.sparse_topk(index["sparse"], retrieval.lexical_weights(q, "query_id", "query"), wide))
    if not found:
        raise ValueError(f"unknown retrieval mode: {params['mode']}")
    hits = retrieval.rrf(found, limit=wide) if len(found) > 1 else found[0]
    named = hits.join(index["points"].select("point_id", F.col("sctid").cast("string").alias("concept"), "fsn", "text"), "point_id")
    return q, retrieval.collapse(named, limit=depth)


def retrieve(inputs, params, ctx):
    q, hits = _retrieved(inputs, params, ctx, int(params["search_depth"]))
    rows = retrieval.retrieve_signal(q, hits)
    return {"matches": rows, "metrics": M.recall_metrics(rows)}


def back_translate(inputs, params, ctx):
    v = inputs["queries"]
    rows = v.df if isinstance(v, Dataset) else v
    return {"translations": models.back_translate(rows, params["id_col"], params["source_col"], _model(ctx, params, "model_id"), params["system"] or "", params["format"]).withColumnRenamed("id", params["id_col"])}


def rerank(inputs, params, ctx):
    q, hits = _retrieved(inputs, params, ctx, int(params["top_k"]))
    out = retrieval.rerank(q, hits.withColumn("text", F.coalesce("text", "fsn")), ctx.models.get("reranker", retrieval.overlap_scorer), int(params["top_k"]))
    gold = q.select("query_id", "gold")
    rows = gold.join(out, "query_id").groupBy("query_id", "gold").agg(F.min_by("concept", "new_rank").alias("top_concept"), F.coalesce(F.min(F.when(F.col("concept") == F.col("gold"), F.col("new_rank"))), F.lit(0)).alias("correct_rank"))
    return {"matches": rows, "metrics": M.recall_metrics(rows)}


def install() -> None:
    """Register all functions."""
    guide = Port("style_guide", ("style_guide",))
    id_, query = Param("id_col", "sctid"), Param("query_col", "query")
    metrics, reference = Port("metrics", ("metrics",)), Port("reference", roles=("sctid", "target"))
    for f in (
        Function("datasource", (), (Port("dataset"),), (Param("source", required=True),), datasource),
        Function("style_guide", (), (guide,), (Param("guide", required=True),), style_guide),
        Function("translate", (Port("terms", roles=TERMS), Port("exemplars", roles=PAIRS), guide), (Port("translations", roles=("sctid", "en", "target")),), (Param("model_key", required=True), Param("limit", kind="number"), Param("resume", False, kind="bool")), translate, ("sctid", "en", "target")),
        Function("translate_consistency", (Port("terms", roles=TERMS), Port("exemplars", roles=PAIRS, required=False), guide), (Port("candidates", ("candidates",), ("sctid", "en", "candidates")),), (Param("model_key", required=True), Param("samples", 5, kind="number"), Param("limit", kind="number")), translate_consistency, ("sctid", "en", "candidates")),
        Function("evaluate", (Port("translations", roles=("sctid", "target")), reference), (Port("rows"), metrics), (Param("limit", kind="number"),), evaluate, ("sctid",)),
        Function("evaluate_consistency", (Port("candidates", ("candidates",), ("sctid", "candidates")), reference), (Port("rows"), metrics), (Param("model_key"), Param("limit", kind="number")), evaluate_consistency, ("sctid",)),
        Function("optimize", (Port("trainset", roles=("sctid", "en", "target")), Port("devset", roles=("sctid", "en", "target"), required=False), Port("seed_style_guide", ("style_guide",), required=False)), (Port("optimized_style_guide", ("style_guide",)), Port("scores", ("metrics",))), (Param("model_key", required=True), Param("reflection_model_key", required=True), Param("rounds", 4, kind="number"), Param("train_limit", kind="number"), Param("dev_limit", kind="number")), optimize),
        Function("evaluate_formula", (metrics,), (Port("score", ("score",)),), (Param("expression", required=True),), evaluate_formula),
        Function("score_workflow_llm", (metrics,), (Port("score", ("score",)),), (Param("prompt", required=True), Param("model_key", required=True)), score_workflow_llm),
        Function("generate_text", (Port("context", ("dataset", "text", "style_guide", "metrics"), required=False),), (Port("text", ("text",)),), (Param("prompt", required=True), Param("model_key", required=True), Param("rows", 50, kind="number")), generate_text),
        Function("build_snomed_index", (Port("concepts", roles=TERMS),), (Port("index", ("index",)),), (), build_index),
        Function("snomed_retrieve", (Port("index", ("index",)), Port("queries")), (Port("matches"), metrics), (id_, query, Param("mode", "hybrid"), Param("search_depth", 10, kind="number")), retrieve),
        Function("back_translate", (Port("queries"),), (Port("translations"),), (Param("model_id", required=True), Param("source_col", "korean"), id_, Param("system", ""), Param("format", "chat")), back_translate),
        Function("rerank", (Port("index", ("index",)), Port("queries")), (Port("matches"), metrics), (id_, query, Param("mode", "hybrid"), Param("top_k", 10, kind="number")), rerank),
    ):
        register(f)


install()
