"""Packing, Merkle manifest and cross-tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import merkle, packing, token_alignment
from termloom.llm.bpe_codec import default_path

PARTS = list("ab1  \n\t'é字。#<>|\x00\x1c▁") + [chr(0x180E), chr(0x200B), "<|endoftext|>", "<s>", "<0x41>", " 's", "'re", "  ", " ", "foo", "Foo bar"]


@pytest.fixture(scope="module")
def odd_texts(rows):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 40))) for _ in range(3000)]
    return [t or "" for _, t, _, _ in rows] + made


# 11
def test_units_give_the_library_ids(odd_texts):
    with open(default_path("byte_bpe_50k.json"), "rb") as f:
        model = packing.ByteBpe(f.read())
    model._units._limit = 2000  # forgets on the way
    want = [e.ids for e in model.library.encode_batch_fast(odd_texts, add_special_tokens=False)]
    for first in range(0, len(odd_texts), 500):
        ids, at = model.encode(odd_texts[first : first + 500])
        for i in range(len(at) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == want[first + i]


def test_cuts_and_bins():
    for n in range(1024):
        parts = packing.cuts(n, 1024, 8)
        assert sum(parts) == n and all(1024 % p <= 8 for p in parts)
    rnd = random.Random(1)
    for capacity, slack in ((1024, 8), (64, 0), (8, 3)):
        packer = packing.Packer(capacity, slack, 5)
        lengths = [rnd.choice((1, 2, 3, 5, 7, 20, 500, 3000)) for _ in range(400)]
        for i, n in enumerate(lengths):
            packer.add(i, np.arange(n, dtype=np.uint32))
        packer.finish()
        made = packer.take()
        filled = Counter()
        for owner, start, n, total, sequence, offset, ids in sorted(made, key=lambda x: (x[4], x[5])):
            assert offset == filled[sequence] and n > 0 and total == lengths[owner]
            assert np.frombuffer(ids, np.uint32).tolist() == list(range(start, start + n))
            filled[sequence] += n
        assert min(filled) == 5 and max(filled.values()) <= capacity
        assert sum(filled.values()) == sum(lengths)
        assert sum(capacity - n for n in filled.values() if n & (n - 1)) <= sum(slack for _ in filled)


def test_packed_documents(docs, empty, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    for i, text, _, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        copies = 2 if i == 95 else 1
        got = sorted(by_doc[i], key=lambda p: p["start"])
        assert sum(p["length"] for p in got) == copies * len(want)
        assert {p["doc_tokens"] for p in got} == {len(want)}
        for p in got:
            assert np.frombuffer(p["ids"], "<u4").tolist() == want[p["start"] : p["start"] + p["length"]]
    assert packing.pack_documents(empty).count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("string"))
    assert packing.pack_documents(nulls).where("doc_id is null").count() > 0


def test_packing_query(spark, sf):
    got = packing.op11_packing(spark, sf)
    again = {tuple(r) for r in got.collect()}
    assert {tuple(r) for r in got.collect()} == again
    padding = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("(n & (n - 1)) <> 0").agg(F.sum(F.lit(1024) - F.col("n"))).first()[0]
    assert padding < 0.01 * got.agg(F.sum("length")).first()[0]


# 12
def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _fields(values):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _root(nodes, proofs):
    """Level by level, not by blocks."""
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for first in range(0, len(nodes), 16):
            run = nodes[first : first + 16]
            for k in range(len(run)):
                for leaf in owners[first + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        owners = [sum(owners[f : f + 16], []) for f in range(0, len(nodes), 16)]
        nodes = [_h(*nodes[f : f + 16]) for f in range(0, len(nodes), 16)]
    return nodes[0]


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, docs, empty, levels):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    more = spark.createDataFrame([(1000 + i, f"T{i % 9} É", None, f"m{i}" if i < 30 else "hot", i) for i in range(700)] + [(None, "x", "en", "hot", None)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.select(*more.columns).unionAll(more)
    fields = [merkle.lowered(F.col(k)) if k == "text" else F.col(k) for k in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_digest(fields))
    got = Counter(tuple(r) for r in merkle.manifest(table, tampered, levels).collect())

    by_source = defaultdict(list)
    for r in table.collect():
        values = [r[k] for k in merkle.FIELDS]
        changed = values[:-1] + [values[-1].translate(lower) if values[-1] is not None else None]
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        by_source[r["source"]].append((r["doc_id"], _fields(values), _fields(changed if hit else values)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, within = [], {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        within[s] = [[] for _ in by_source[s]]
        tops.append(_root([x[1] for x in by_source[s]], within[s]))
    over = [[] for _ in order]
    root = _root(tops, over)
    want = Counter()
    for k, s in enumerate(order):
        for (i, leaf, changed), proof in zip(by_source[s], within[s], strict=True):
            folded, path = changed, proof + over[k]
            for before, after in path:
                folded = _h(before, folded, after)
            want[i, leaf, tops[k], root, _h(*(b + a for b, a in path)), folded, folded == root] += 1
    assert got == want
    assert len({x[-1] for x in got}) == 2
    assert merkle.manifest(empty).count() == 0


# 13
def _plain_alignment(model, text):
    a, b = model.a.encode(" " + text, add_special_tokens=False).ids, model.b.encode(text)
    raw = (" " + text).encode()
    if not text or b"".join(model.a_bytes[x] for x in a) != raw or b"".join(model.b_bytes[x] for x in b) != raw:
        return 0, 0, 0, "", Counter()
    ends = [np.cumsum([len(by[x]) for x in ids]).tolist() for ids, by in ((a, model.a_bytes), (b, model.b_bytes))]
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, links, i, j = [], Counter(), 0, 0
    for e in both:
        m, n = ends[0].index(e) + 1, ends[1].index(e) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        links[a[m - 1], b[n - 1]] += 1
        i, j = m, n
    return len(a), len(b), len(both), ";".join(groups), links


def test_alignment(docs, empty, rows, odd_texts):
    model = token_alignment.aligner_of(*token_alignment._files(None, None))
    pairs = [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in model.pairs]
    found, groups, links, times, at = model.align(odd_texts)
    for i, text in enumerate(odd_texts):
        if len(text) < 5000:
            want = _plain_alignment(model, text)
            assert (*found[i].tolist(), groups[i]) == want[:4]
            assert {pairs[k]: n for k, n in zip(links[at[i] : at[i + 1]].tolist(), times[at[i] : at[i + 1]].tolist(), strict=True)} == want[4]

    some = docs.where(F.length(F.coalesce("text", F.lit(""))) < 5000)
    plain = [(r["doc_id"], *_plain_alignment(model, r["text"] or "")) for r in some.collect()]
    total = Counter()
    for row in plain:
        total.update(row[5])
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    want = Counter((i, a, b, g, sum(n for p, n in k.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in k.items())) for i, a, b, g, _, k in plain)
    aligned = token_alignment.align_documents(some)
    counts = token_alignment.link_counts(aligned)
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == total
    scored = token_alignment.scored_documents(aligned, counts, len(pairs))
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_best"], r["count_sum"]) for r in scored.collect()) == want
    none = token_alignment.align_documents(empty)
    assert token_alignment.scored_documents(none, token_alignment.link_counts(none), len(pairs)).count() == 0


def test_one_text_longer_than_a_block(spark, monkeypatch):
    """Blocks end between texts; a longer text is a block of its own."""
    import pyarrow as pa

    from termloom.llm import units

    texts = ["ab " * 40, None, "", "x y " * 900, "c", "d" * 300]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})
    found = list(units.blocks(batch, limit=100))
    assert [(f, e) for f, e, _ in found] == [(0, 1), (1, 4), (4, 6)]
    assert [t for _, _, part in found for t in part] == [t or "" for t in texts]

    with open(default_path("byte_bpe_50k.json"), "rb") as f:
        model = packing.ByteBpe(f.read())
    long = " ".join(random.Random(9).choice(["alpha", "beta,", "gámma", "日本", "a\nb", "<|endoftext|>", "", "x\t"]) for _ in range(400_000))
    assert len(long) > units.BLOCK
    ids, at = model.encode([long, "tail"])
    assert ids[: at[1]].tolist() == model.library.encode(long, add_special_tokens=False).ids
