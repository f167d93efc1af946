import random

import pytest


def words(rnd, n, vocabulary):
    return [rnd.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): nulls, blanks, long texts, copies, near copies, shared passages, ties, repeated rows."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    accents = [w + "é" for w in vocab[:200]]
    passage = " ".join(words(rnd, 90, vocab))
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = " ".join(words(rnd, rnd.randrange(3, 220), vocab if i % 3 else accents + vocab[:50]))
        if i % 7 == 0:
            text += "\n" + passage + "\n" + " ".join(words(rnd, 20, vocab))
        out.append((i, text, lang, f"s{i % 4}"))
    for i in range(60, 75):  # near copies of a few
        base = out[i % 5 * 7][1].split(" ")
        for _ in range(rnd.randrange(1, 6)):
            base[rnd.randrange(len(base))] = rnd.choice(vocab)
        out.append((i, " ".join(base), "en", "s0"))
    for i in range(75, 85):  # copies
        out.append((i, out[i % 3][1], "en", "s0"))
    out += [
        (85, None, "en", "s1"),
        (86, "", "fr", None),
        (87, " \n\t ", None, "s2"),
        (88, "one two", "en", "s2"),
        (89, "ONE  two", "en", "s3"),
        (90, "12345 $$$ 678", "en", "s3"),
        (91, " ".join(words(rnd, 30_000, vocab)), "en", "s3"),
        (92, "x" * 5000, None, "s3"),
        (93, "ab " * 700, "en", "s3"),
        (94, "Released under the MIT License.\ncc by nc, CC-BY-NC 4.0\n日本語 <|endoftext|> naïve Σ", "en", "s0"),
        (95, out[3][1], "en", "s1"),
        (95, out[3][1], "en", "s1"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with n_chars and extra columns whose names the operators use inside."""
    made = [(i, t, lang, s, len(t or ""), 1, "x", 2.0, [1]) for i, t, lang, s in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score double, k1 array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
