"""Model calls as row operators.

A model is a callable (system, user) -> text given by the caller; a partition
calls it through a thread pool, failures become ``ERROR: ...`` rows, and the
rows keep their keys, so arrival order never matters. Outputs are written once
(``checkpointed``) because calls are expensive and need not repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import replies as R
from ..functions import rules, text as T
from ..session import ship
from ..sources.positions import POSITION
from ..sources.tables import cached_lookup, checkpointed, resume_by_key
from . import metrics as M
from .order import spread
from .pairs import group_candidates, hashed
from .retrieval import SPARSE_KEPT, prune_sparse

Model = Callable[[str, str], str]
#: Calls that a thread makes one after another before it takes more.
CALLS = 16


def complete(prompts: DataFrame, model: Model, threads: int = 8) -> DataFrame:
    """prompts(id, system, user) -> the rows with ``reply`` and ``ok``; asked in as many tasks as the shuffles have."""
    ship(prompts.sparkSession)

    def ask(row: tuple[str, str]) -> tuple[str, bool]:
        try:
            return model(row[0] or "", row[1] or ""), True
        except Exception as e:  # noqa: BLE001  a failed call is a row
            return f"ERROR: {e}", False

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in parts:
                rows = list(zip(pdf["system"], pdf["user"], strict=True))
                step = max(1, min(CALLS, len(rows) // threads))
                got = [g for few in pool.map(lambda at: [ask(r) for r in rows[at : at + step]], range(0, len(rows), step)) for g in few]
                yield pdf.assign(reply=[g[0] for g in got], ok=[g[1] for g in got])

    return spread(prompts).mapInPandas(run, StructType([*prompts.schema.fields, StructField("reply", StringType()), StructField("ok", BooleanType())]))


def translate(terms: DataFrame, exemplars: DataFrame | None, guide: str, model: Model, done: DataFrame | None = None, threads: int = 8) -> DataFrame:
    """terms(sctid, en) with exemplars(sctid, en, target, rank): (sctid, en, target, ok); ids in ``done`` are skipped.

    The place of the terms in their file is kept, if they have one.
    """
    place = [POSITION] if POSITION in terms.columns else []
    todo = resume_by_key(terms, done, "sctid") if done is not None else terms
    if exemplars is not None:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "en", "target"))), lambda x: F.struct(x["en"], x["target"]))
        todo = todo.join(exemplars.groupBy("sctid").agg(listed.alias("pairs")), "sctid", "left")
    else:
        todo = todo.withColumn("pairs", F.array().cast("array<struct<en:string,target:string>>"))
    table = T.pair_table(F.coalesce("pairs", F.array().cast("array<struct<en:string,target:string>>")))
    user = T.context_sections([("Examples:", table), ("Term:", F.col("en"))])
    out = complete(todo.select("sctid", "en", *place, F.lit(guide).alias("system"), user.alias("user")), model, threads)
    return checkpointed(out.select("sctid", "en", *place, F.when(F.col("ok"), R.first_line_bare(F.col("reply"))).otherwise(F.col("reply")).alias("target"), "ok"), "translations")


def translate_samples(terms: DataFrame, guide: str, model: Model, samples: int = 5, threads: int = 8) -> DataFrame:
    """Each term translated several times, grouped: (sctid, en, n_samples, n_distinct, candidates, top_candidate)."""
    asked = terms.select("sctid", "en", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("pos"))
    prompt = asked.select("sctid", "en", "pos", F.lit(guide).alias("system"), F.concat("en", F.lit("\n#"), F.col("pos").cast("string")).alias("user"))
    got = checkpointed(complete(prompt, model, threads).select("sctid", "pos", R.first_line_bare(F.col("reply")).alias("target")), "samples")
    return terms.select("sctid", "en", *([POSITION] if POSITION in terms.columns else [])).join(group_candidates(got, "sctid", "target"), "sctid")


def back_translate(rows: DataFrame, id_col: str, source_col: str, model: Model, system: str = "", prompt_format: str = "chat", languages: tuple[str, str] = ("Korean", "English"), threads: int = 8) -> DataFrame:
    """(id, query) in the other language; blank sources are skipped; two prompt formats."""
    src = rows.where(T.text_or_empty(F.col(source_col)) != "")
    if prompt_format == "chat":
        user = F.col(source_col)
        system = system or f"Translate the {languages[0]} clinical term into {languages[1]}. Answer with the term only."
    elif prompt_format == "structured":
        user, system = F.concat(F.lit(f"<source lang={languages[0]}>"), F.col(source_col), F.lit(f"</source><target lang={languages[1]}>")), ""
    else:
        raise ValueError(f"unknown prompt format: {prompt_format}")
    out = complete(src.select(F.col(id_col).alias("id"), F.lit(system).alias("system"), user.alias("user")), model, threads)
    return checkpointed(out.select("id", R.first_line_bare(F.col("reply")).alias("query")), "queries")


def judge_candidates(candidates: DataFrame, model: Model, threads: int = 8) -> DataFrame:
    """Chosen candidate of each row(sctid, candidates): a judge is asked only where there are several; unreadable answers mean the majority."""
    many = candidates.where(F.size("candidates") > 1)
    listed = F.array_join(F.transform("candidates", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])), "\n")
    asked = complete(many.select("sctid", "candidates", F.lit("Choose the best. Answer BEST: n").alias("system"), listed.alias("user")), model, threads)
    index = R.best_index(F.col("reply"), F.size("candidates"))
    judged = checkpointed(asked.select("sctid", F.element_at(F.col("candidates"), F.coalesce(index, F.lit(1)))["text"].alias("target"), index.isNotNull().cast("int").alias("judged"), R.reason(F.col("reply")).alias("reason")), "judged")
    single = candidates.where(F.size("candidates") == 1).select("sctid", F.col("candidates")[0]["text"].alias("target"), F.lit(0).alias("judged"), F.lit("").alias("reason"))
    return judged.unionByName(single)


def judge_rows(rows: DataFrame, user: Column, system: str, model: Model, parse: dict[str, Callable[[Column], Column]], threads: int = 8) -> DataFrame:
    """Rows with parsed fields of a judge's reply."""
    asked = complete(rows.withColumn("system", F.lit(system)).withColumn("user", user), model, threads)
    return checkpointed(asked.select(*rows.columns, *[p(F.col("reply")).alias(n) for n, p in parse.items()], "ok"), "judgements")


def cached_translations(rows: DataFrame, cache: DataFrame | None, language: str, model: Model) -> DataFrame:
    """(key, target) of rows(sctid, en): by the cache where it has the concept in that language."""
    keyed = rows.select(F.concat_ws("_", "sctid", F.lit(language)).alias("key"), "en")
    compute = lambda d: complete(d.select("key", F.lit(language).alias("system"), F.col("en").alias("user")), model).select("key", F.col("reply").alias("target"))
    return checkpointed(cached_lookup(keyed, cache, "key", compute), "translated")


def generate(model: Model, context: dict[str, str], template: str, most: int = 4000) -> str:
    """Text from a template whose names are the wired texts, each cut to ``most`` characters."""
    cut = {k: v if len(v) <= most else v[:most] + "\n…[truncated]" for k, v in context.items()}
    cut.setdefault("context", "\n\n".join(cut.values()))
    import re

    unknown = [t for t in T.template_tokens(template) if t not in cut]
    if unknown:
        raise ValueError(f"unknown template names: {unknown}")
    return model("", re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: cut[m[1]], template))


def score_metrics(model: Model, prompt: str, vector: dict[str, float]) -> float:
    """A model's score of a metric vector; ``{{metrics}}`` lists all of it."""
    import re

    listed = "\n".join(f"{k}: {v:g}" for k, v in sorted(vector.items()))
    said = model("", re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: listed if m[1] == "metrics" else f"{vector[m[1]]:g}", prompt))
    said = re.sub(r"(?s)<think>.*?</think>", "", said)
    found = re.findall(r"(?i)SCORE\s*:\s*(-?\d+(?:\.\d+)?)", said) or re.findall(r"-?\d+(?:\.\d+)?", said)
    if not found:
        raise ValueError("no score in the reply")
    return float(found[-1])


def optimise_rules(start: Sequence[str], propose: Callable[[list[str], int], str | None], score: Callable[[list[str]], tuple[float, float]], patience: int = 5, gain: float = 0.005, slack: float = 0.015, ablation: float = 0.003) -> tuple[list[str], list[dict]]:
    """Grow a rule list while it helps, then drop rules that do not.

    ``score(rules)`` gives (train, held-out), computed on DataFrames. A proposal is
    accepted if held-out rises by more than ``gain``, or train does and held-out
    falls by at most ``slack``.
    """
    kept, history = list(start), []
    best_train, best_hold = score(kept)
    failures = step = 0
    while failures < patience:
        rule = propose(kept, step)
        step += 1
        if rule is None:
            break
        train, hold = score([*kept, rule])
        ok = hold > best_hold + gain or (train > best_train + gain and hold >= best_hold - slack)
        history.append({"rule": rule, "train": train, "holdout": hold, "accepted": ok})
        if ok:
            kept.append(rule)
            best_train, best_hold, failures = max(train, best_train), max(hold, best_hold), 0
        else:
            failures += 1
    for rule in list(kept):
        rest = [r for r in kept if r != rule]
        _, hold = score(rest)
        if best_hold - hold <= ablation:
            kept = rest
            history.append({"rule": rule, "dropped": True, "holdout": hold})
    return kept, history


def optimise_guide(seed: str, reflect: Callable[[str, float], str], train: Callable[[str], float], rounds: int = 4) -> tuple[str, dict[str, float]]:
    """Reflective search for a better guide; scores before and after use the same metric as the search."""
    best, score = seed, train(seed)
    before = score
    for _ in range(rounds):
        new = reflect(best, score)
        value = train(new)
        if value > score:
            best, score = new, value
    return best, {"before": before, "after": score}


def guide_metric(outputs: DataFrame, hard: Sequence[rules.HardRule]) -> DataFrame:
    """Mean of .5 exact + .5 chrF less penalties over outputs(candidate, refs)."""
    from ..functions import similarity as S

    exact = S.exact_match(F.col("candidate"), F.col("refs"))
    value = S.composite(exact, S.best_chrf(F.col("candidate"), F.col("refs"))["chrf"], rules.penalty(F.col("candidate"), hard))
    return outputs.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("score"))


def reflective_agent(terms: DataFrame, draft: Model, critic: Model, enrich: Callable[[DataFrame], DataFrame], steps: int = 3) -> DataFrame:
    """Draft, enrich, reflect, revise: terms(sctid, en) until the critic says OK or the steps are used; only open rows go on."""
    state = complete(terms.select("sctid", "en", F.lit("draft").alias("system"), F.col("en").alias("user")), draft).select("sctid", "en", F.col("reply").alias("target"))
    state = checkpointed(state, "draft")
    finished = None
    for step in range(steps):
        seen = enrich(state)
        notes = complete(seen.select("sctid", "en", "target", F.lit("reflect").alias("system"), F.concat_ws("\n", "en", "target", "context").alias("user")), critic)
        notes = checkpointed(notes.select("sctid", "en", "target", F.col("reply").alias("note")), "notes")
        good = notes.where(F.upper(T.strip(F.col("note"))).startswith("OK")).select("sctid", "en", "target", F.lit(step).alias("steps"))
        finished = good if finished is None else finished.unionByName(good)
        left = notes.where(~F.upper(T.strip(F.col("note"))).startswith("OK"))
        revised = complete(left.select("sctid", "en", F.lit("revise").alias("system"), F.concat_ws("\n", "en", "target", "note").alias("user")), draft)
        state = checkpointed(revised.select("sctid", "en", F.col("reply").alias("target")), "revised")
        if state.isEmpty():
            return finished
    return finished.unionByName(state.withColumn("steps", F.lit(steps)))


def sampling_sweep(terms: DataFrame, configs: Sequence[dict], model_of: Callable[[dict], Model], refs: DataFrame, samples: int = 3) -> DataFrame:
    """One summary row per sampling configuration: mean exact and chrF of the majority candidate."""
    rows = None
    for c in configs:
        got = translate_samples(terms, "", model_of(c), samples)
        scored = M.score_rows(got.select("sctid", F.lit(0).alias("pos"), F.col("top_candidate").alias("candidate")), refs)
        one = M.composite_metrics(scored).withColumn("config", F.lit(str(c.get("name", c))))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def embed(rows: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(id, vector) by an embedding model, batch by batch."""
    ship(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "vector": model(pdf["text"].fillna("").tolist())})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, vector array<float>")


def embed_both(rows: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], list[tuple[list[float], dict[str, float]]]], most: int = SPARSE_KEPT) -> DataFrame:
    """(id, vector, weights) by one call a batch: the dense vector and the ``most`` heaviest sparse weights, as (weight, token) from the heaviest on."""
    ship(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = model(pdf["text"].fillna("").tolist())
            yield pd.DataFrame({"id": pdf["id"], "vector": [d for d, _ in got], "sparse": [dict(s) for _, s in got]})

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, vector array<float>, sparse map<string,double>")
    return out.select("id", "vector", prune_sparse(F.col("sparse"), most).alias("weights"))


def sparse_table(embedded: DataFrame) -> DataFrame:
    """(id, token, weight) of ``embed_both``, as sparse search takes it."""
    return embedded.select("id", F.explode("weights").alias("w")).select("id", "w.token", "w.weight")


def hashing_embedder(texts: list[str], width: int = 32) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: hashed character trigrams."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * width
        for i in range(len(t) - 2):
            v[zlib.crc32(t[i : i + 3].lower().encode()) % width] += 1.0
        out.append(v)
    return out


def order_by_hash(rows: DataFrame, key: str, seed: str) -> DataFrame:
    return rows.orderBy(hashed(F.col(key), seed), key)
