import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import bpe_codec, embedding_dedup, jaccard_join, language_id, license_scan, lm_scoring, media, mixing, substring_dedup, token_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


# 1
def test_language_id(docs, empty, rows):
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for i, text, lang, _ in rows:
        r = got[i]
        assert 0 <= r["score"] <= 1
        if not any(x.isalpha() for x in text or ""):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
        elif i < 60:
            assert r["lang_pred"] == lang and not r["rejected"]
    kept = language_id.kept_languages(docs)
    assert kept.columns == docs.columns
    assert not {85, 86, 87, 90} & {r["doc_id"] for r in kept.collect()}
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}


def test_kneser_ney_by_the_book():
    """Every probability against dictionaries: interpolated, with continuation counts below the highest order."""
    texts = ["abracadabra abba cab", "dab a cab abra", "caba"]
    key, _, _ = language_id.grams(texts)
    keys, n = np.unique(key, return_counts=True)
    symbols = len(np.unique(key & np.uint64(0xFFFF)))
    model = language_id.CharModel(keys, n, symbols)
    gram = lambda k: tuple(int(k) >> (16 * i) & 0xFFFF for i in (3, 2, 1, 0))
    count = {4: Counter({gram(k): int(c) for k, c in zip(keys, n, strict=True)})}
    for o in (3, 2, 1):
        count[o] = Counter(g[1:] for g in count[o + 1])

    def p(g):
        if not g:
            return 1 / (symbols + 1)
        c = count[len(g)]
        n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
        d = min(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, 0.95)
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        return max(c[g] - d, 0) / total + d * len(same) / total * p(g[1:]) if total else p(g[1:])

    rnd = random.Random(1)
    letters = sorted({x for g in count[4] for x in g}) + [0x4E00]
    asked = [*count[4], *[tuple(rnd.choice(letters) for _ in range(4)) for _ in range(300)]]
    packed = np.array([g[0] << 48 | g[1] << 32 | g[2] << 16 | g[3] for g in asked], np.uint64)
    assert np.allclose(np.exp(model.log_probability(packed)), [p(g) for g in asked], rtol=1e-9)


def test_language_id_of_a_dirty_column(spark, docs):
    """Only the most frequent languages are learned."""
    from pyspark.sql import functions as F

    dirty = docs.withColumn("lang", F.when(F.col("doc_id") >= 60, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    assert language_id.fit(dirty, most_langs=2).langs == ["en", "fr"]


def test_kneser_ney_sums_to_one():
    key, _, _ = language_id.grams(["abracadabra abba", "cab dab"])
    keys, n = np.unique(key, return_counts=True)
    model = language_id.CharModel(keys, n, len(np.unique(key & np.uint64(0xFFFF))))
    letters = np.unique(key & np.uint64(0xFFFF))
    for context in keys[:6] >> np.uint64(16):
        every = (context << np.uint64(16)) | letters
        total = np.exp(model.log_probability(every)).sum() + np.exp(model.log_probability(np.array([(context << np.uint64(16)) | np.uint64(0x4E00)], np.uint64)))[0]
        assert abs(total - 1) < 1e-9


# 2
def test_bpe_equals_the_library(docs, empty, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_codec.default_path())
    got = {r["doc_id"]: r for r in bpe_codec.encode_documents(docs, with_ids=True).collect()}
    for i, text, _, _ in rows:
        want = lib.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.encode_documents(empty).count() == 0


def test_bpe_odd_characters():
    from tokenizers import Tokenizer

    path = bpe_codec.default_path()
    lib, own = Tokenizer.from_file(path), bpe_codec.WordBpe(open(path, "rb").read())
    for x in ["ΑΣ Σ", "İ K Å ﬁ", "a\x85b\x1cc", "<|endoftext|>a<|startoftext|>", "<|endoftext", "it's WE'LL", "한국어 مرحبا हिन्दी", "⵿ \U00020000 \U0001f600 ՘", "x" * 999]:
        assert own.encode(x)[0].tolist() == lib.encode(x, add_special_tokens=False).ids, x


def test_bpe_combining_marks():
    """Pairs of marks, whose order the library's older tables and Python's may see differently, and random strings."""
    import unicodedata

    from tokenizers import Tokenizer

    path = bpe_codec.default_path()
    lib, own = Tokenizer.from_file(path), bpe_codec.WordBpe(open(path, "rb").read())
    rnd = random.Random(3)
    common = [chr(i) for i in range(0x300, 0x370)]
    marks = [chr(i) for i in range(0x10000) if unicodedata.combining(chr(i))]
    texts = ["a" + x + y for x in common for y in common] + ["e" + x + y for x in marks for y in rnd.sample(marks, 12)]
    texts += ["e" + rnd.choice(common) + x for x in marks] + ["".join(chr(rnd.choice([rnd.randrange(0x20, 0x250), rnd.randrange(0x300, 0xD800), rnd.randrange(0xE000, 0x10000)])) for _ in range(rnd.randrange(1, 9))) for _ in range(5000)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x for x, w in zip(texts, want, strict=True) if own.encode(x)[0].tolist() != w] == []


# 3
def read_png(media):
    """(width, height, depth, colour, samples) of a PNG without row filters, by the format's rules."""
    assert media[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, kinds, data = 8, [], b""
    while at < len(media):
        n, kind = int.from_bytes(media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        assert int.from_bytes(media[at + 8 + n : at + 12 + n]) == zlib.crc32(kind + body)
        kinds.append(kind)
        header = body if kind == b"IHDR" else header
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    w, h = int.from_bytes(header[:4]), int.from_bytes(header[4:8])
    lines = zlib.decompress(data)
    rows = [lines[k * (w + 1) : (k + 1) * (w + 1)] for k in range(h)]
    assert all(r[0] == 0 for r in rows) and len(lines) == h * (w + 1)
    return w, h, header[8], header[9], b"".join(r[1:] for r in rows)


def plain_feature(payload):
    rows = [payload[k : k + 64] for k in range(0, len(payload), 64)]
    mean = sum(payload) / len(payload)
    spread = math.sqrt(sum((b - mean) ** 2 for b in payload) / len(payload))
    bits = ""
    for k in range(8):
        first = min(int(len(rows) * k / 8), len(rows) - 1)
        band = rows[first : max(int(len(rows) * (k + 1) / 8), int(len(rows) * k / 8) + 1)] or rows[-1:]
        cells = [[b for r in band for b in r[int(64 * j / 9) : int(64 * (j + 1) / 9)]] for j in range(9)]
        means = [sum(x) / len(x) for x in cells]
        bits += "".join("1" if b > a else "0" for a, b in zip(means, means[1:], strict=False))
    return f"64x{len(rows)}", mean, spread, f"{int(bits, 2):016x}"


def test_media_round_trip(spark, tmp_path, rows):
    tmp = str(tmp_path)
    spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string").write.parquet(f"{tmp}/documents.parquet")
    got = defaultdict(list)
    for r in media.op3_media_columns(spark, tmp).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, _, _ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.to_media(payload)
        assert read_png(stored) == (64, len(payload) // 64, 8, 0, payload)
        shape, mean, spread, bits = plain_feature(payload)
        for r in got[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r["media_bytes"], r["media_sha256"], r["position"]) == (len(stored), hashlib.sha256(stored).hexdigest(), 1 if (text or "").split() else 0)
            f = r["feature"].split(":")
            assert (f[0], f[3]) == (shape, bits) and abs(float(f[1]) - mean) < 1e-4 and abs(float(f[2]) - spread) < 1e-4


def test_interleaving(spark):
    html = '<p>One <b>two</b></p><figure><img src="sha256:ab" alt="x"><figcaption>Cap &amp; tion</figcaption></figure><script>no</script>tail<img src="y.png" alt="z"><img>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain < text")], "key long, html string")
    got = [tuple(r)[1:] for r in media.interleave(pages).where("key = 1").orderBy("position").collect()]
    assert got == [(0, "text", "One two", None, None), (1, "media", None, "sha256:ab", "Cap & tion"), (2, "text", "tail", None, None), (3, "media", None, "y.png", "z")]
    assert media.interleave(pages).where("key in (2, 3)").count() == 0
    stored = media.store_payloads(spark.createDataFrame([(b"q",), (b"q",), (None,)], "raw binary"))
    assert {media.from_media(bytes(r["media"])) for r in stored.collect()} == {b"q" + bytes(63), bytes(64)}
    assert media.described(stored).count() == 2
    own = spark.createDataFrame([(1, f'a<img src="sha256:{hashlib.sha256(b"q").hexdigest()}" alt="q">b<img src="sha256:00">')], "key long, html string")
    found = [(r["position"], r["content"], r["caption"], r["payload_bytes"]) for r in media.resolve(media.interleave(own), media.described(stored)).orderBy("position").collect()]
    assert found == [(0, "a", None, None), (1, None, "q", 64), (2, "b", None, None), (3, None, None, None)]


# 4
def test_token_counts(docs, empty, rows):
    import sentencepiece

    path = bpe_codec.default_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in token_counts.count_documents(docs).collect()}
    for i, text, _, _ in rows:
        n = len(lib.encode(text or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 4096)
    assert token_counts.count_documents(empty).count() == 0
    own = token_counts.PieceBpe(open(path, "rb").read())
    for x in ["", " ", "   a  b", "naïve \n\n text <s> 日本 ", "▁▁x", "internationalisation"]:
        assert own.every_prefix(x).tolist() == [len(lib.encode(x[:k])) for k in range(len(x) + 1)]
        for budget in range(6):
            longest = max(k for k in range(len(x) + 1) if len(lib.encode(x[:k])) <= budget)
            assert own.truncate(x, budget) == x[:longest]
    few = {r["doc_id"]: r for r in token_counts.count_documents(docs, limit=40).collect()}
    for i, text, _, _ in rows:
        text = text or ""
        if len(text) < 2000:
            assert few[i]["fitting_chars"] == max(k for k in range(len(text) + 1) if len(lib.encode(text[:k])) <= 40)
    cut = own.truncate("some words to be cut here", 3)
    assert len(lib.encode(cut)) <= 3 < len(lib.encode("some words to be cut here"[: len(cut) + 1]))


# 5
def mixed(rows):
    size = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, _, s in rows]
    sources = sorted({s for _, s, _ in size}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, t, n in size if t == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, left, budget = {}, set(sources), sum(total.values())
    while True:
        rest = budget - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        over = [s for s in left if share[s] > 3 * total[s]]
        if not over:
            return size, total, target | share
        worst = min(over, key=lambda s: total[s] / weight[s])
        target[worst] = 3.0 * total[worst]
        left.remove(worst)


def test_mixing(docs, empty, rows):
    size, total, target = mixed(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    longest = {s: max(n for _, t, n in size if t == s) for s in total}
    for s in total:
        assert abs(taken[s] - target[s]) <= longest[s]
    assert sum(taken.values()) <= sum(total.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=str)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(empty).count() == 0


# 6
def test_license_scan(docs, empty, rows):
    got = defaultdict(list)
    for r in license_scan.scan(docs).collect():
        got[r["doc_id"]].append(r)
    for i, text, _, _ in rows:
        low = (text or "").translate(LOW)
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places, base, found, best = [], set(), set(), 0.0
        for phrase, label in license_scan.BASE:
            q = phrase.split()
            at = [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
            places += at
            base |= {label} if at else set()
        for words, label in license_scan.TEMPLATES:
            q, n = set(words.split()), license_scan.block_length(words)
            most = max((len(q & set(w[k : k + n])) for k in range(len(w))), default=0) / len(q)
            if most >= 0.8 - 1e-9:
                found.add(label)
                best = max(best, most)
        want = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)
        for r in got[i]:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == want
    assert license_scan.scan(empty).count() == 0


def test_license_blocks_are_all_found(spark):
    """Every block that meets a template, by brute force: of overlapping ones the best, the first of equal ones."""
    said = "Released under the MIT License"
    far = " filler" * 40
    texts = [said + far + " " + said, far, said + " " + said, said + " x " + said + far + said.lower(), "under the mit license" + far + said]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = sorted((r["key"], r["at"], r["containment"]) for r in license_scan.scan_blocks(df).collect() if r["template"] == 0)
    want = []
    words = set(license_scan.TEMPLATES[0][0].split())
    length, need = license_scan.block_length(license_scan.TEMPLATES[0][0]), math.ceil(0.8 * len(words))
    for key, text in enumerate(texts):
        w, kept = text.lower().split(), []
        for at in range(len(w)):
            same = len(words & set(w[at : at + length]))
            if same >= need:
                if kept and at < kept[-1][1] + length:
                    if same > kept[-1][2]:
                        kept[-1] = (key, at, same)
                else:
                    kept.append((key, at, same))
        want += [(k, at, same / len(words)) for k, at, same in kept]
    assert [x[0] for x in got] == [x[0] for x in want] and [x[2] for x in got] == [x[2] for x in want]
    assert len([x for x in got if x[0] == 0]) == 2 and not [x for x in got if x[0] == 1]


def test_license_sentences_may_wrap(spark):
    rows, scattered = [], []
    for words, label in license_scan.TEMPLATES:
        w = words.split()
        for k in range(1, len(w)):
            rows.append((len(rows), "Header 2026\n * " + " ".join(w[:k]) + "\n * " + " ".join(w[k:]) + "\nmore", label))
        scattered.append((1000 + len(scattered), " filler\nother text here ".join(w), ""))
    rows.append((len(rows), "this wor\u212a is under the gnu general public license version", ""))
    rows.append((len(rows), "Creative Commons -- Attribution, ShareAlike", "cc-by-sa"))
    rows.append((len(rows), "Creative Commons Attribution", ""))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")"
    rows += [(len(rows), mit, "mit"), *scattered]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    for i, _, label in rows:
        assert (label in got[i]["labels"].split(",") and got[i]["score"] == 1.0) if label else got[i]["labels"] == "", i


# 7
def repeated(raws, length):
    """Per text: which bytes are covered by a string of this length that starts anywhere else too."""
    seen = Counter(b[p : p + length] for b in raws for p in range(len(b) - length + 1))
    out = []
    for b in raws:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        out.append(np.cumsum(cover)[:-1] > 0)
    return out


def runs(on):
    return int((np.diff(np.r_[0, on.astype(int)]) == 1).sum())


def passages(b, on, words=50):
    """The covered bytes whose run has more than so many words."""
    edge = np.diff(np.r_[0, on.astype(int), 0])
    out = np.zeros(len(b), bool)
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        out[s:e] = len(re.findall(rb"[^\x20\x09-\x0d]+", b[s:e])) > words
    return out


def test_substring_dedup(spark, docs, empty, rows, tmp_path):
    raws = [(t or "").encode() for _, t, _, _ in rows]
    want = defaultdict(list)
    for (i, *_), b, on, short in zip(rows, raws, repeated(raws, 400), repeated(raws, 240), strict=True):
        short = passages(b, short)
        want[i].append((len(b), int(on.sum()), runs(on), hashlib.sha256(np.frombuffer(b, np.uint8)[~on].tobytes()).hexdigest(), int(short.sum()), runs(short)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in substring_dedup.op7_substring_dedup(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["passage_bytes"], r["n_passages"]))
    assert got == want
    assert substring_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [240, 400])
def test_texts_without_repeats(docs, rows, length):
    raws = [(t or "").encode() for _, t, _, _ in rows]
    want = Counter()
    for (i, text, *_), b, on in zip(rows, raws, repeated(raws, length), strict=True):
        on = passages(b, on)
        if not on.any():
            want[i, text] += 1
            continue
        on = np.r_[False, on, False]
        at, kept = 0, ""
        for s, e in zip(np.flatnonzero(~on[:-1] & on[1:]).tolist(), np.flatnonzero(on[:-1] & ~on[1:]).tolist(), strict=True):
            while s < len(b) and b[s] & 0xC0 == 0x80:
                s += 1
            while s < e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            kept, at = kept + b[at:s].decode(), e
        kept += b[at:].decode()
        if kept:
            want[i, kept] += 1
    out = substring_dedup.without_repeats(docs, length)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_repeats_that_split_characters(spark):
    """Runs of two-byte characters that differ in their first or last byte only."""
    common = "ab" * 30 + "".join(chr(0x100 + k % 64) for k in range(150))
    texts = ["é" + common + "é", "ã" + common + "ĩ", "x" + common + "ę"]
    out = substring_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=0)
    assert sorted(r["text"] for r in out.collect()) == sorted(["éé", "ãĩ", "xę"])


# 8
def test_lm_scoring(docs, empty, rows):
    ready = docs.select("doc_id", "text", lm_scoring.held_out(docs["doc_id"]).alias("held_out"))
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(ready).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    count = Counter(w for i, t, _, _ in rows if not out[i] for w in [*split(t), "\n"])
    n, v = sum(count.values()), len(count)
    for i, text, _, _ in rows:
        w, r = [*split(text), "\n"], got[i]
        want = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert abs(r["base_score"] - want) < 1e-9 * abs(want) + 1e-9
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(w), sum(count[x] > 0 for x in w), n)
        assert r["score"] < 0
    assert sum(got[i]["score"] for i in got) > sum(got[i]["base_score"] for i in got)
    assert lm_scoring.score_documents(ready.limit(0)).count() == 0


def test_lm_score_has_every_count(docs, rows):
    """``score`` of exact counts on the log scale, whatever the number of ranges."""
    ready = docs.select("doc_id", "text", lm_scoring.held_out(docs["doc_id"]).alias("held_out"))
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    word, pair = Counter(), Counter()
    for i, text, _, _ in rows:
        w = [*split(text), "\n"]
        if not out[i]:
            word.update(w)
            pair.update(zip(["\n", *w[:-1]], w, strict=True))
    n, v = sum(word.values()), len(word)
    mix = 1 - sum(x == 1 for x in pair.values()) / n
    assert 0.05 < mix < 0.95 and sum(x == 1 for x in pair.values()) > len(pair) / 2

    def count(x):
        return float(lm_scoring.value_of(lm_scoring.level_of(np.array([x])))[0]) if x else 0.0

    def logp(a, b):
        p = (count(word[b]) + 1) / (n + v + 1)
        if not word[a]:
            return math.log10(p)
        return math.log10(mix * min(count(pair[a, b]) / count(word[a]), 1) + (1 - mix) * p)

    near = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(ready).collect()}
    far = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(ready.repartition(7)).collect()}
    assert near.keys() == far.keys() == out.keys()
    for i, text, _, _ in rows:
        w = [*split(text), "\n"]
        want = sum(map(logp, ["\n", *w[:-1]], w))
        assert abs(near[i] - want) < 0.02 * abs(want) + 0.7, i  # what wrong probes may change
        assert abs(near[i] - far[i]) < 1e-9 * abs(want) + 1e-9


def test_log_counts():
    n = np.arange(1, 5000)
    value = lm_scoring.value_of(lm_scoring.level_of(n))
    assert (np.maximum(value / n, n / value) <= math.sqrt(2) + 1e-9).all()


# 9
def components(rows):
    sets = {}
    for i, t, _, _ in rows:
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components(docs, empty, rows):
    want = components(rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert sum(c != i for i, (_, c) in want.items()) > 10
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_of_one_id_with_different_texts(spark):
    u, t = ([f"{x}{i}" for i in range(60)] for x in "ut")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(u)), (5, " ".join(t)), (5, near(u)), (7, near(t)), (None, " ".join(t)), (None, "alone"), (9, "alone too")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 56, 1), (5, 56, 5), (5, 56, 1), (7, 56, 5), (-1, 56, 5), (-1, 1, -1), (9, 1, 9)])


def test_jaccard_groups_that_only_members_join(spark):
    """Many texts of one template, some linked and some not, against brute force."""
    rnd = random.Random(8)
    base = [[f"{x}{i}" for i in range(80)] for x in "abc"]
    rows = []
    for i in range(120):
        w = list(base[i % 3])
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6])):
            w[rnd.randrange(80)] = f"n{rnd.randrange(40)}"
        rows.append((i, " ".join(w), None, None))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_jaccard_chains_and_thresholds(spark):
    base = [f"w{i}" for i in range(104)]
    texts = [" ".join(base)]
    for k in range(8):  # each step changes one more word, so the ends are apart but a chain joins them
        base = [*base]
        base[k * 12] = f"new{k}"
        texts.append(" ".join(base))
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == components(rows) and {c for _, c in got.values()} == {0}


# 10
@pytest.mark.parametrize("width", [16])
def test_embedding_dedup(spark, width):
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((120, width))
    near = np.repeat(base[:20], 6, axis=0) + 0.08 * rnd.standard_normal((120, width))
    x = np.concatenate([base, near, base[:5], base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * width), (902, [float("nan")] * width), (903, [None] * width), (904, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("label", __import__("pyspark").sql.functions.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), label[i], label[i] == i)
    for i, _ in bad:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("goal", [0.97, 1.01])
def test_embedding_dedup_links_between_tight_groups(spark, goal):
    """Two groups larger than any list, linked with each other; a goal above 1 takes the exact way for all."""
    rnd = np.random.default_rng(4)
    q = np.linalg.qr(rnd.standard_normal((16, 16)))[0]
    centre = [q[0], 0.91 * q[0] + math.sqrt(1 - 0.91**2) * q[1]]
    x = np.concatenate([np.repeat(centre, 100, axis=0) + 0.004 * rnd.standard_normal((200, 16)), rnd.standard_normal((60, 16))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert link[:100, 100:200].mean() > 0.9 and not link[:200, 200:].any()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, goal=goal).collect()}
    for i in range(200):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), 0, i == 0)


def test_embedding_dedup_keeps_null_ids(spark):
    rows = [(None, [1.0, 0.0]), (-1, [0.0, 1.0]), (3, [1.0, 0.01]), (None, [-1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == Counter([(None, 1, 3, False), (-1, 0, -1, True), (3, 1, 3, True), (None, 0, None, True), (None, 0, None, True)])


def linked(x, ids):
    """(links, component) of each row by brute force."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            return Counter(zip(ids, link.sum(axis=1).tolist(), label.tolist(), strict=True))
        label = new


def outcome(spark, x, ids):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    return Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())


def test_embedding_dedup_of_a_few(spark):
    x = np.array([[1, 0, 0], [1, 0.01, 0], [0, 1, 0]])
    assert outcome(spark, x, [1, 2, 3]) == linked(x, [1, 2, 3])
    x = np.array([[1, 0, 0], [0, 1, 0], [0, 1, 0.01], [1, 0.01, 0], [1, 0.01, 0]])
    assert outcome(spark, x, [5, 5, 7, 8, 8]) == linked(x, [5, 5, 7, 8, 8])
    rnd = np.random.default_rng(5)
    x = np.repeat(rnd.standard_normal((3, 5000)), 2, axis=0) + 0.01 * rnd.standard_normal((6, 5000))
    assert outcome(spark, x, list(range(6))) == linked(x, list(range(6)))


def test_embedding_dedup_of_large_groups(spark, monkeypatch):
    """Groups of several blocks, tight ones and a chain, beside vectors without links."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rnd = np.random.default_rng(6)
    tight = rnd.standard_normal((1, 24)) + 0.02 * rnd.standard_normal((300, 24))
    turn = np.arange(0, 1.5, 0.01)[:, None]
    chain = np.cos(turn) * np.eye(24)[0] + np.sin(turn) * np.eye(24)[1]
    x = np.concatenate([rnd.standard_normal((150, 24)), tight, chain])
    ids = rnd.permutation(len(x)).tolist()
    assert outcome(spark, x, ids) == linked(x, ids)


def test_lm_scoring_lets_its_largest_shuffle_go(spark, monkeypatch):
    from pyspark.sql import functions as F

    from termloom.llm import _common, lm_scoring

    order = []
    written, let_go = _common.materialize, _common.release
    monkeypatch.setattr(_common, "materialize", lambda df, name: order.append(name) or written(df, name))
    monkeypatch.setattr(_common, "release", lambda s: order.append("release") or let_go(s))
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    assert lm_scoring.score_documents(docs).count() == 2
    assert order == ["blocks", "told", "release"]
