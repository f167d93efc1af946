"""Dictionary matching: the automaton and the ways beyond its size give the same, as brute force does."""

import random
import re

import pytest

from termloom.operators import dictionary as D


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 4))) for _ in range(60)]
    texts = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (82, "Ab,C  é D\tAB"), (3, "ab c")]
    keys = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 5))) for _ in range(400)] + ["AB c", "", None, "zz zz zz", "d ab"]
    return texts, keys, spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(k,) for k in keys], "key string")


def _plain(text):
    return re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", (text or "").lower())).strip(" ")


@pytest.mark.parametrize("sent", [D.SENT_CHARS, 10])
def test_phrases(made, sent):
    texts, keys, t, k = made
    known = {p for x in keys if x is not None and len(p := _plain(x)) >= 4}
    want = {(i, p) for i, x in texts if x is not None for p in known if f" {p} " in f" {_plain(x)} "}
    got = [(r["id"], r["key"]) for r in D.phrase_hits(t, k, sent_chars=sent).collect()]
    assert set(got) == want and len(want) > 50
    unique = t.where("id <> 3")
    best = {r["id"]: r["hits"] for r in D.glossary_matches(unique, k, sent_chars=sent).collect()}
    for i, x in texts:
        if i != 3:
            kept = []
            for p in sorted((p for j, p in want if j == i), key=lambda p: (-len(p), p)):
                if len(kept) < 6 and not any(p in q for q in kept):
                    kept.append(p)
            assert best[i] == kept
    assert D.phrase_hits(t.limit(0), k, sent_chars=sent).count() == 0
    assert D.phrase_hits(t, k.limit(0), sent_chars=sent).count() == 0


@pytest.mark.parametrize("sent", [D.SENT_CHARS, 500])
def test_longest_forms(made, sent):
    texts, keys, t, k = made
    forms = {x for x in keys if x}
    got = {r["id"]: r["form"] for r in D.longest_forms(t.where("id <> 3"), k.withColumnRenamed("key", "form"), sent).collect()}
    for i, x in texts:
        if i != 3:
            found = sorted((f for f in forms if f in (x or "")), key=lambda f: (-len(f), f))
            assert got[i] == (found[0] if found else None)
