"""Scores of candidates, rankings, detectors and judges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from .order import quantiles, running, spread
from .pairs import last_wins


def split_references(ref: Column, many: Column | None = None, sep: str = "|") -> Column:
    """References of a row: the split column without blanks, else the single one."""
    one = F.array(F.coalesce(ref, F.lit("")))
    if many is None:
        return one
    parts = F.filter(F.transform(F.split(F.coalesce(many, F.lit("")), f"\\{sep}"), T.strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(one)


def score_rows(candidates: DataFrame, references: DataFrame, key: str = "sctid") -> DataFrame:
    """candidates(key, pos, candidate) scored against references(key, pos, refs); duplicate keys: the last wins."""
    both = last_wins(references, key).select(key, "refs", F.col("pos").alias("_ref_pos")).join(last_wins(candidates, key).select(key, "candidate"), key)
    both = spread(both)  # a join of small rows is few tasks, scoring takes CPU
    best = S.best_chrf(F.col("candidate"), F.col("refs"))
    out = both.withColumn("_best", best).withColumn("exact", S.exact_match(F.col("candidate"), F.col("refs")).cast("int"))
    return out.select(key, "candidate", F.col("_best.reference").alias("best_ref"), "exact", F.round("_best.chrf", 4).alias("chrf"))


def composite_metrics(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: n, exact_match_pct, mean_chrf and the composite; only weights of computed scores count, re-normalised."""
    w = {"exact_match": 0.2, "chrf": 0.5} | {k: v for k, v in (weights or {}).items() if k in ("exact_match", "chrf")}
    total = sum(w.values())
    exact, chrf = F.coalesce(F.avg("exact"), F.lit(0.0)), F.coalesce(F.avg("chrf"), F.lit(0.0))
    value = (w["exact_match"] * exact + w["chrf"] * chrf / 100) / total if total else F.lit(0.0)
    return scored.agg(F.count("*").alias("n"), F.round(exact * 100, 6).alias("exact_match_pct"), F.round(chrf, 6).alias("mean_chrf"), F.round(value, 6).alias("composite_score"))


def recall_metrics(rows: DataFrame, by: Sequence[str] = (), ranks: Sequence[int] = (1, 3, 5, 10), gold: Column | None = None) -> DataFrame:
    """recall@K in per cent and MRR of rows(correct_rank); rank 0 is a miss; n_queries counts rows without gold too."""
    has = gold if gold is not None else F.lit(True)
    n = F.sum(has.cast("int"))
    at = [F.round(F.coalesce(F.try_divide(F.sum((has & (F.col("correct_rank") >= 1) & (F.col("correct_rank") <= k)).cast("int")) * 100.0, n), F.lit(0.0)), 4).alias(f"recall_at_{k}") for k in ranks]
    mrr = F.round(F.coalesce(F.try_divide(F.sum(F.when(has & (F.col("correct_rank") > 0), 1.0 / F.col("correct_rank")).otherwise(0.0)), n), F.lit(0.0)), 4).alias("mrr")
    return rows.groupBy(*by).agg(F.count("*").alias("n_queries"), *at, mrr)


def auc(rows: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks of ties; null if a class is empty.

    Scores are aggregated first, so ranks come from running sums over distinct scores, by ranges of scores.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = known.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    per = running(per, ["_s"], "n", by, "below")
    rank_sum = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    p, q = F.sum("pos").cast("double"), F.sum(F.col("n") - F.col("pos")).cast("double")
    return per.groupBy(*by).agg(F.round(F.try_divide(rank_sum - p * (p + 1) / 2, p * q), 6).alias("auc"), F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"))


def precision_coverage(rows: DataFrame, score: str, label: str, steps: int = 10) -> DataFrame:
    """Precision and coverage at thresholds lo + (hi - lo) * i / steps; a row counts if its score is at least that."""
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("n")).first()
    if not ends["n"]:
        return rows.sparkSession.createDataFrame([], "step int, threshold double, n long, coverage double, precision double")
    cuts = [(i, ends["lo"] + (ends["hi"] - ends["lo"]) * (i / steps)) for i in range(steps)]
    agg = []
    for i, t in cuts:
        hit = F.col(score) >= t
        agg += [F.sum(hit.cast("long")).alias(f"n{i}"), F.sum((hit & (F.col(label) == 1)).cast("long")).alias(f"p{i}")]
    one = rows.where(F.col(score).isNotNull()).agg(F.count("*").alias("total"), *agg)
    cells = [F.struct(F.lit(i).alias("step"), F.round(F.lit(float(t)), 6).alias("threshold"), F.col(f"n{i}").alias("n"), F.round(F.col(f"n{i}") / F.col("total"), 6).alias("coverage"), F.round(F.coalesce(F.try_divide(F.col(f"p{i}"), F.col(f"n{i}")), F.lit(0.0)), 6).alias("precision")) for i, t in cuts]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def error_detector(rows: DataFrame, similarity: str, flagged: Column, cut: float = 0.6) -> DataFrame:
    """A detector that flags rows, held against similarity >= cut as correct: precision, recall, clean bucket."""
    wrong = F.col(similarity) < cut
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    hit, f, w = n(flagged & wrong), n(flagged), n(wrong)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return rows.agg(F.count("*").alias("n"), f.alias("n_flagged"), w.alias("n_wrong"), ratio(hit, f).alias("precision"), ratio(hit, w).alias("recall"), n(~flagged).alias("n_clean"), ratio(n(~flagged & ~wrong), n(~flagged)).alias("clean_accuracy"))


def calibration(rows: DataFrame, level: str, value: str, exact: str) -> DataFrame:
    """Per confidence level: n, mean value, share of exact, and the share and mean that are kept from this level on."""
    per = rows.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n"), F.sum(value).alias("v"), F.sum(F.col(exact).cast("long")).alias("e"))
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(0))
    return per.select("level", "n", F.round(F.col("v") / F.col("n"), 6).alias("mean_value"), F.round(F.col("e") / F.col("n"), 6).alias("exact_share"), F.round(F.sum("n").over(up) / F.sum("n").over(all_), 6).alias("kept_share"), F.round(F.sum("v").over(up) / F.sum("n").over(up), 6).alias("kept_mean"))


def with_hierarchy(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows with the hierarchy of labels(key, hierarchy): '(unmapped)' where the key is missing, '(no tag)' where the name is blank."""
    named = labels.select(key, F.when(T.text_or_empty(F.col("hierarchy")) == "", "(no tag)").otherwise(F.col("hierarchy")).alias("hierarchy"))
    return rows.join(named, key, "left").withColumn("hierarchy", F.coalesce("hierarchy", F.lit("(unmapped)")))


def calibration_correlation(rows: DataFrame, level: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of confidence and value, overall or by group; null where one of them does not vary."""
    known = rows.where(F.col(level).isNotNull() & F.col(value).isNotNull())
    r = F.when((F.stddev_pop(level) > 0) & (F.stddev_pop(value) > 0), F.corr(F.col(level).cast("double"), F.col(value).cast("double")))
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.round(r, 6).alias("pearson"))


def confidence_routing(rows: DataFrame, level: str, value: str, exact: str, levels: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """For each cutoff what is kept (confidence at least the cutoff) and what is routed to people: counts, mean values, share of exact."""
    cut = F.explode(F.array(*map(F.lit, levels))).alias("cutoff")
    per = rows.groupBy(F.col(level).alias("_l")).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"), F.sum(F.col(exact).cast("long")).alias("_e"))
    each = per.select("*", cut)
    keep, route = F.col("_l") >= F.col("cutoff"), F.coalesce(F.col("_l") < F.col("cutoff"), F.lit(True))
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    mean = lambda c, x: F.round(F.try_divide(F.sum(F.when(c, F.col(x))).cast("double"), F.sum(F.when(c, F.col("_n")))), 6)
    return each.groupBy("cutoff").agg(total(keep, "_n").alias("n_kept"), mean(keep, "_v").alias("kept_mean"), mean(keep, "_e").alias("kept_exact"), total(route, "_n").alias("n_routed"), mean(route, "_v").alias("routed_mean"))


def similarity_crosstab(rows: DataFrame, similarity: str, label: str, labels: Sequence[str], edges: Sequence[float] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """Counts of labels by similarity bucket, with totals; buckets are named by their lower edge."""
    bucket = F.lit(None).cast("double")
    for e in edges:
        bucket = F.when(F.col(similarity) >= e, F.lit(float(e))).otherwise(bucket)
    b = rows.withColumn("bucket", bucket)
    return b.groupBy("bucket").agg(*[F.sum((F.col(label) == x).cast("long")).alias(f"n_{x}") for x in labels], F.count("*").alias("total"))


def label_spread(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Per label: n, mean, upper median, least and greatest value."""
    # Equal values are counted first: the window sees distinct values only.
    per = rows.where(F.col(value).isNotNull()).groupBy(label, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(label).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_end", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy(label)))
    upper = F.min(F.when(F.col("_end") > F.floor(F.col("_all") / 2), F.col("_v")))
    mean = F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")
    return per.groupBy(label).agg(F.sum("_n").alias("n"), F.round(mean, 6).alias("mean"), upper.alias("median"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))


def percentiles(rows: DataFrame, value: str, by: Sequence[str] = (), points: Sequence[int] = (10, 50, 90)) -> DataFrame:
    """Exact percentiles by counts of distinct values, so no task holds all values of a group."""
    found = quantiles(rows, value, [q / 100 for q in points], by)
    named = found.select(*by, *[F.round(F.col(f"q{i}"), 6).alias(f"p{q}") for i, q in enumerate(points)])
    if not by:
        return named
    every = rows.select(*by).distinct()  # groups without a value have null percentiles
    return every.join(named, [every[k].eqNullSafe(named[k]) for k in by], "left").select(*[every[k] for k in by], *[f"p{q}" for q in points])


def pairwise_summary(verdicts: DataFrame) -> DataFrame:
    """Two-pass pairwise verdicts(id, mode, winner) per id, counted: identical, error, consistent A, B, tie, inconsistent."""
    per = verdicts.groupBy("id").agg(F.max((F.col("mode") == "identical").cast("int")).alias("same"), F.max(F.col("winner").isNull().cast("int")).alias("bad"), F.count_distinct("winner").alias("kinds"), F.min("winner").alias("w"))
    outcome = F.when(F.col("same") == 1, "identical").when(F.col("bad") == 1, "error").when(F.col("kinds") == 1, F.concat(F.lit("consistent_"), F.col("w"))).otherwise("inconsistent")
    return per.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def tally(rows: DataFrame, group: str, winner: str) -> DataFrame:
    """Wins by group, and of all groups under '__ALL__'."""
    both = rows.select(F.explode(F.array(F.col(group).cast("string"), F.lit("__ALL__"))).alias("hierarchy"), F.col(winner).alias("winner"))
    return both.groupBy("hierarchy", "winner").agg(F.count("*").alias("n"))


def consistency_scores(candidates: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """candidates(key, candidates) against references(key, refs): chrF of the first (majority) and the best (oracle) candidate."""
    both = candidates.join(references, key)
    each = both.select(key, "candidates", F.posexplode("candidates").alias("i", "x"), "refs")
    each = each.withColumn("s", F.round(S.best_chrf(F.col("x.text"), F.col("refs"))["chrf"], 4))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"])
    out = each.groupBy(key).agg(F.first("candidates").alias("candidates"), scores.alias("scores"))
    return out.select(key, F.size("candidates").alias("n_candidates"), F.array_max("scores").alias("oracle_chrf"), F.array_position("scores", F.array_max("scores")).alias("oracle_index"), F.element_at("scores", 1).alias("majority_chrf"), (F.element_at("scores", 1) >= F.array_max("scores") - 1e-6).cast("int").alias("chose_oracle"))


def consistency_summary(scored: DataFrame) -> DataFrame:
    """Calibration over the rows with more than one candidate."""
    many = F.col("n_candidates") > 1
    return scored.agg(F.count("*").alias("n"), F.sum(many.cast("long")).alias("n_multi_candidate"), F.round(F.avg("majority_chrf"), 6).alias("mean_chrf"), F.round(F.coalesce(F.avg(F.when(many, F.col("chose_oracle"))), F.lit(0.0)), 6).alias("majority_oracle_accuracy"))


def top_coverage_precision(rows: DataFrame, signal: str, label: str, share: float) -> DataFrame:
    """Precision among the top share of rows, ordered by (signal, label) downwards."""
    # Rows are aggregated by (signal, label) first: only distinct pairs are ordered, by ranges.
    per = rows.groupBy(F.col(signal).alias("s"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    per = running(per, [F.desc("s"), F.desc("l")], "n", into="before").withColumn("keep", F.floor(F.col("before_all") * share))
    took = F.greatest(F.lit(0), F.least(F.col("n"), F.col("keep") - F.col("before")))
    return per.agg(F.sum(took).alias("kept"), F.round(F.coalesce(F.try_divide(F.sum(took * F.col("l")), F.sum(took)), F.lit(0.0)), 6).alias("precision"))


def histogram(rows: DataFrame, value: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins on [0, 1]; values at 1 fall into the last."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def token_cost(rows: DataFrame, input_tokens: str, output_tokens: str, per_million: tuple[float, float], by: Sequence[str] = ()) -> DataFrame:
    cost = (F.sum(input_tokens) * per_million[0] + F.sum(output_tokens) * per_million[1]) / 1e6
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(cost, 6).alias("cost"))
