from pyspark.sql import functions as F

from termloom.operators import models as M


def test_errors_become_rows(spark):
    def model(system, user):
        if user == "bad":
            raise RuntimeError("no")
        return user.upper()

    rows = spark.createDataFrame([(1, "s", "a"), (2, "s", "bad")], "id long, system string, user string")
    got = {r["id"]: (r["reply"], r["ok"]) for r in M.complete(rows, model).collect()}
    assert got == {1: ("A", True), 2: ("ERROR: no", False)}


def test_judge_only_asks_where_needed(spark):
    def model(system, user):
        return "BEST: 2" if "b1" in user else "who knows"

    c = "sctid string, candidates array<struct<text:string,count:bigint>>"
    rows = spark.createDataFrame([("1", [("a1", 2), ("b1", 1)]), ("2", [("only", 1)]), ("3", [("x", 1), ("y", 1)])], c)
    got = {r["sctid"]: (r["target"], r["judged"]) for r in M.judge_candidates(rows, model).collect()}
    assert got == {"1": ("b1", 1), "2": ("only", 0), "3": ("x", 0)}


def test_back_translate(spark):
    rows = spark.createDataFrame([("1", "심장"), ("2", " ")], "sctid string, korean string")
    got = M.back_translate(rows, "sctid", "korean", lambda s, u: '"Heart."\nbecause').collect()
    assert [(r["id"], r["query"]) for r in got] == [("1", "Heart")]


def test_rule_optimiser():
    gains = {"good": 0.1, "bad": -0.1}
    kept, history = M.optimise_rules([], lambda kept, i: ["good", "bad"][i] if i < 2 else None, lambda rules: (sum(gains[r] for r in rules),) * 2)
    assert kept == ["good"] and [h.get("accepted") for h in history] == [True, False]


def test_generate_and_score():
    assert M.generate(lambda s, u: u, {"a": "x" * 10}, "A {{a}} B", most=4).startswith("A xxxx\n")
    assert M.score_metrics(lambda s, u: "SCORE: 7.5" if "n: 3" in u else "", "{{metrics}}", {"n": 3}) == 7.5


def test_cached_translations(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "sctid string, en string")
    cache = spark.createDataFrame([("1_KO", "cached")], "key string, target string")
    got = {r["key"]: r["target"] for r in M.cached_translations(rows, cache, "KO", lambda s, u: u.upper()).collect()}
    assert got == {"1_KO": "cached", "2_KO": "B"}


def test_reflective_agent(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "bb")], "sctid string, en string")
    draft = lambda s, u: u.split("\n")[0] + ("!" if s == "revise" else "")
    critic = lambda s, u: "OK" if "!" in u or u.startswith("a") else "no"
    got = {r["sctid"]: (r["target"], r["steps"]) for r in M.reflective_agent(rows, draft, critic, lambda d: d.withColumn("context", F.lit(""))).collect()}
    assert got == {"1": ("a", 0), "2": ("bb!", 1)}


def test_dense_and_sparse_by_one_call(spark):
    """Sparse weights are pruned to the heaviest, and search among equal payloads only."""
    from termloom.operators import models, retrieval

    calls = []

    def both(texts):
        calls.append(len(texts))
        return [([float(len(t)), 1.0], {w: float(t.split().count(w)) for w in t.split()}) for t in texts]

    rows = spark.createDataFrame([(1, "a a b c"), (2, "b b b"), (3, None), (4, "c c a")], "id long, text string")
    out = models.embed_both(rows, "id", "text", both, most=2)
    got = {r["id"]: (list(r["vector"]), [tuple(w) for w in r["weights"]]) for r in out.collect()}
    assert got[1] == ([7.0, 1.0], [(2.0, "a"), (1.0, "b")]) and got[3] == ([0.0, 1.0], [])
    table = models.sparse_table(out)
    payload = spark.createDataFrame([(1, "x"), (2, "y"), (4, "x"), (3, None)], "id long, value string")
    hits = retrieval.sparse_topk(retrieval.within_payload(table, payload), retrieval.within_payload(table, payload), 5)
    assert {(r["query_id"], r["point_id"]) for r in hits.collect()} == {(1, 1), (1, 4), (4, 4), (4, 1), (2, 2)}
