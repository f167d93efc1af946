import random

from pyspark.sql import functions as F

from termloom.operators import corpus, graph, metrics, pairs, retrieval, sampling


def test_pair_dedupe(spark):
    rows = spark.createDataFrame([(1, "Heart", "심장"), (2, "heart ", "심장"), (3, "Heart", "염통"), (4, " ", "x"), (5, "y", None)], "pos long, en string, target string")
    assert [r["pos"] for r in pairs.dedupe_pairs(rows).orderBy("pos").collect()] == [1, 3]


def test_group_candidates(spark):
    rows = spark.createDataFrame([("c", i, t) for i, t in enumerate(["a b", "ab", "ERROR: x", "c", ""])], "id string, pos long, text string")
    got = pairs.group_candidates(rows, "id", "text").first()
    assert [(c["text"], c["count"]) for c in got["candidates"]] == [("a b", 2), ("c", 1)]
    assert got["top_candidate"] == "a b"


def test_recall(spark):
    rows = spark.createDataFrame([(1, 1), (4, 1), (0, 1), (2, 1), (0, 0)], "correct_rank int, gold int")
    r = metrics.recall_metrics(rows, gold=F.col("gold") == 1).first()
    assert (r["n_queries"], r["recall_at_1"], r["recall_at_3"], r["recall_at_5"], r["recall_at_10"], r["mrr"]) == (5, 25, 50, 75, 75, 0.4375)


def test_auc_against_pairs(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)]
    assert metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] == 0.875
    rnd = random.Random(3)
    rows = [(rnd.randrange(6) / 5, rnd.randrange(2)) for _ in range(60)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] - want) < 1e-6
    flipped = [(-s, y) for s, y in rows]
    assert abs(metrics.auc(spark.createDataFrame(flipped, "s double, y int"), "s", "y").first()["auc"] - (1 - want)) < 2e-6
    assert metrics.auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()["auc"] is None


def test_composite(spark):
    rows = spark.createDataFrame([(1, 60.0), (0, 60.0)], "exact int, chrf double")
    assert metrics.composite_metrics(rows).first()["composite_score"] == 0.571429


def test_retrieve_signal(spark):
    hits = spark.createDataFrame([(1, "A", 0.91239, 1), (1, "G", 0.80001, 2)], "query_id long, concept string, score double, rank int")
    q = spark.createDataFrame([(1, "G"), (2, "G")], "query_id long, gold string")
    got = {r["query_id"]: r for r in retrieval.retrieve_signal(q, hits).collect()}
    assert (got[1]["top_score"], got[1]["second_score"], got[1]["margin"], got[1]["correct_rank"], got[1]["candidates"]) == (0.9124, 0.8, 0.1124, 2, "A|G")
    assert got[2]["top_concept"] is None and got[2]["top_score"] == 0 and got[2]["correct_rank"] == 0


def test_collapse_keeps_first_of_equals(spark):
    hits = spark.createDataFrame([(1, 10, "A", 0.5, 1), (1, 11, "A", 0.5, 2), (1, 12, None, 0.4, 3), (1, 13, "B", 0.3, 4)], "query_id long, point_id long, concept string, score double, rank int")
    assert [(r["point_id"], r["rank"]) for r in retrieval.collapse(hits).orderBy("rank").collect()] == [(10, 1), (13, 2)]


def test_dense_topk_ties_and_bad_vectors(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 1.0])], "point_id long, vector array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["point_id"], r["score"]) for r in retrieval.dense_topk(pts, q, 2).orderBy("rank").collect()] == [(2, 1.0), (3, 0.0)]


def test_rerank_promotes(spark):
    import pandas as pd

    q = spark.createDataFrame([(1, "q"), (2, "none")], "query_id long, query string")
    hits = spark.createDataFrame([(1, "A", "a", 1), (1, "B", "b", 2), (1, "GOLD", "GOLD", 3)], "query_id long, concept string, text string, rank int")
    rows = {(r["query_id"], r["concept"]): r["new_rank"] for r in retrieval.rerank(q, hits, lambda a, b: pd.Series([1.0 if "GOLD" in x else 0.1 for x in b])).collect()}
    assert rows == {(1, "GOLD"): 1, (1, "A"): 2, (1, "B"): 3, (2, None): 0}


def test_spread(spark):
    pick = lambda n, k: [r["i"] for r in sampling.spread(spark.range(n).withColumnRenamed("id", "i"), ["i"], k).orderBy("i").collect()]
    assert (pick(10, 3), pick(10, 4), pick(3, 5)) == ([0, 3, 6], [0, 2, 4, 6], [0, 1, 2])
    assert list(sampling.quotas(100, "abc").values()) == [34, 33, 33]


def test_document_threshold():
    assert [corpus.document_threshold(n) for n in (1, 10, 200, 1000)] == [1, 2, 4, 20]


def test_shingles_of_short_text(spark):
    got = spark.range(1).select(corpus.shingles(F.lit("a b c")).alias("s")).first()["s"]
    assert got == ["a", "b", "c"]


def test_closure_on_a_polyhierarchy(spark):
    e = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("e", "d")], "child string, parent string")
    got = {(r["node"], r["ancestor"]) for r in graph.ancestor_closure(e).collect()}
    assert got == {("d", "b"), ("d", "c"), ("d", "a"), ("b", "a"), ("c", "a"), ("e", "d"), ("e", "b"), ("e", "c"), ("e", "a")}
    below = {r["node"] for r in graph.descendants(e, spark.createDataFrame([("b",)], "node string")).collect()}
    assert below == {"b", "d", "e"}
    assert {r["node"] for r in graph.scope("<<b MINUS e", e).collect()} == {"b", "d"}


def test_coherence_of_one_candidate(spark):
    c = spark.createDataFrame([(1, 1, "x")], "query_id long, rank int, node string")
    r = graph.coherence(c, spark.createDataFrame([("x", "y")], "node string, ancestor string")).first()
    assert (r["jaccard"], r["lineage"], r["common_depth"]) == (1.0, 1.0, 0)


def test_clean_corpus_drops_boilerplate(spark):
    body = [(i, f"Common licence paragraph that stands in every one of these documents here.\n\nOwn paragraph {'xyz'[i % 3] * 3} number {chr(97 + i)}{chr(98 + i)} about something that is only in this text {chr(99 + i) * 5}.") for i in range(12)]
    out, counters = corpus.clean_corpus(spark.createDataFrame(body, "doc_id long, text string"), hashes=16)
    assert all("Common" not in r["text"] and "Own" in r["text"] for r in out.collect())
    assert counters.first()["dropped_frequent"] + counters.first()["dropped_edge"] == 12


def test_minimal_pairs(spark):
    rows = spark.createDataFrame([(1, "red ball"), (2, "blue ball"), (3, "red cat")], "id long, t string")
    got = sampling.minimal_pairs(rows, "t", "red|blue", "id").collect()
    assert [(r["text_a"], r["text_b"]) for r in got] == [("blue ball", "red ball")]


def test_clean_corpus_writes_texts_once(spark):
    import os
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    body = [(i, "\n\n".join(" ".join(draw.choices(words, k=60)) for _ in range(20))) for i in range(200)]
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    used = lambda: sum(os.path.getsize(os.path.join(f, n)) for f, _, names in os.walk(root) for n in names)
    before = used()
    out, counters = corpus.clean_corpus(spark.createDataFrame(body, "doc_id long, text string"))
    assert counters.first()["kept"] == counters.first()["chunks"] == 4000
    assert {r["doc_id"]: r["text"] for r in out.collect()} == dict(body)
    assert used() - before < 2 * sum(len(t) for _, t in body)


def test_exemplars_of_equal_words_are_asked_once(spark, monkeypatch):
    names = ["red bolt", "blue bolt", "red ring", "steel plate", "bolt red"]
    table = spark.createDataFrame([(i, names[i % 5]) for i in range(200)], "id long, text string")
    asked = []
    plain = retrieval._sparse_nearest
    monkeypatch.setattr(retrieval, "_sparse_nearest", lambda p, q, k: asked.append((p.select("id").distinct().count(), q.select("id").distinct().count())) or plain(p, q, k))
    queries = table.where("id % 2 = 0").select(F.col("id").alias("query_id"), "text")
    got = retrieval.exemplar_lookup(queries, retrieval.lexical_weights(table, "id", "text"), 2)
    want = {0: 2.0, 1: 2.0, 2: 2.0, 3: 2.0, 4: 2.0}
    rows = got.orderBy("query_id", "rank").collect()
    assert len(rows) == 2 * 100 and all(r["score"] == want[r["query_id"] % 5] for r in rows)
    assert [r["point_id"] for r in rows if r["query_id"] == 10] == [0, 4] == [r["point_id"] for r in rows if r["query_id"] == 14]
    # 4 sets of words as names and 5 words of more than three letters; 6 exemplars of each name.
    assert asked == [(24, 9)]
