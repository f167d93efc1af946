import os
import re
import sys
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from termloom.llm import bpe_codec, queries, substring_dedup

sys.path.insert(0, os.path.dirname(__file__))

from test_llm_operators import components, mixed, passages, repeated  # noqa: E402


def test_stages(spark, docs, tmp_path):
    """Each stage against brute force over what its predecessor kept."""
    now, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        kept.append(now.collect())
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # 1: only what is no language goes; 92 is one letter five thousand times.
    first = Counter((r["doc_id"], r["text"]) for r in kept[0])
    assert first + Counter(x for x in every if x[0] == 92 and x not in first) == Counter(x for x in every if x[0] not in {85, 86, 87, 90})
    # 2: of each component the smallest id; repeated rows are one document.
    rows = sorted({(r["doc_id"], r["text"]) for r in kept[0]})
    want = components([(i, t, None, None) for i, t in rows])
    assert sorted((r["doc_id"], r["text"]) for r in kept[1]) == [x for x in rows if want[x[0]][1] == x[0]]
    # 3: the bytes of repeated passages go, and documents that are nothing else.
    rows = [(r["doc_id"], r["text"]) for r in kept[1]]
    raws = [t.encode() for _, t in rows]
    left = {}
    for (i, _), b, on in zip(rows, raws, repeated(raws, substring_dedup.PASSAGE), strict=True):
        rest = bytes(x for x, gone in zip(b, passages(b, on), strict=True) if not gone)  # the fixture repeats plain letters only
        if rest or not b:
            left[i] = rest.decode()
    assert {r["doc_id"]: r["text"] for r in kept[2]} == left and any(passages(b, on).any() for b, on in zip(raws, repeated(raws, substring_dedup.PASSAGE), strict=True))
    # 4: each source's words near its target, documents as often as the mix takes them.
    size, total, target = mixed([(r["doc_id"], r["text"], None, r["source"]) for r in kept[2]])
    source = {r["doc_id"]: r["source"] for r in kept[2]}
    words = {i: n for i, _, n in size}
    taken = Counter()
    for r in kept[3]:
        assert r["text"] == left[r["doc_id"]]
        taken[source[r["doc_id"]]] += words[r["doc_id"]]
    for s in total:
        assert abs(taken[s] - target[s]) <= max(n for i, n in words.items() if source[i] == s)
    # 5: the library's tokens.
    lib = Tokenizer.from_file(bpe_codec.default_path())
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in left.items()}
    assert Counter(r["doc_id"] for r in kept[4]) == Counter(r["doc_id"] for r in kept[3])
    assert all(r["ids"] == ids[r["doc_id"]] for r in kept[4])


def test_near_duplicates_of_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text + " end"), (None, "alone"), (3, text), (3, "other text of this id"), (3, text), (2, text), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.ngram_jaccard(spark, docs, "").collect())
    assert out == sorted([(2, text), (0, "alone"), (3, "other text of this id"), (4, "")])


def test_run_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_thirteen_queries():
    names = sorted((n for n in queries.queries() if n.startswith("op")), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
