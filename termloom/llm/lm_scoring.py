"""Operator 8: language-model scoring with a log-frequency Bloom filter.

Texts are split once: a table of blocks (about 1 MB of text each) holds the distinct
words of each block and its tokens as places among them.

Counting. Each block sends its distinct words and bigrams by hash range, with how
often its training documents have them; a reducer per range sums them up. What all
documents have is sent once a block and not once a document.

Model. Word and bigram counts are quantised on a logarithmic scale (two levels
per doubling) and written into a Bloom filter: an n-gram of level q inserts
(n-gram, 1), ..., (n-gram, q), so its level is read back by probing 1, 2, ...
until a probe fails, and errors are one-sided and rare. Every n-gram of the
training documents is in it, whatever its count: the filter has one segment for
each hash range, and a segment is as large as the items of its range need. It grows
with the corpus, so it is not broadcast: a segment is probed in its range, for all
n-grams that the blocks have sent, and each block is told the levels of its n-grams
and the exact counts of its words (``base_score``).

Scoring. Probability of a word w after v, with probes for all counts:
``mix * c(vw) / c(v) + (1 - mix) * (c(w) + 1) / (N + V + 1)``; where the pair was
never seen in training its first term is 0, and where v was never seen it is
``(c(w) + 1) / (N + V + 1)`` alone. ``mix`` is fitted by leaving one out: the share of
training bigrams that another occurrence backs, 1 - (bigrams seen once) / N.

Tokens are 64-bit hashes: among a thousand million distinct words no two are
expected to share one (0.03 pairs). Bigrams have 48 bits, whose collisions are far
rarer than the filter's own errors.

Defined results: null text is empty and has the end token only; without any
training document all counts are 0; repeated rows each get their row; a null
doc_id is not held out and not trained on; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

_U = np.uint64
#: Hash of the end token (a word's hash equals it with a chance of 2^-64).
END = c.mix(np.array([0x5EED], _U))[0]
#: Probes per item, and quantisation levels per doubling.
PROBES, STEPS = 4, 2
#: Bytes of text in a block: words that many of its documents share are handled once a block.
BLOCK = 1 << 20


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes in order, first index of each document); each document ends with END."""
    h, owner, _, _ = c.words_of(data, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(owner, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.full(at[-1], END, _U)
    out[np.arange(len(h)) + owner] = h
    return out, at


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8").astype(_U)


def _pack6(h: np.ndarray) -> bytes:
    """48 bits each: the high 16 bits of all, then the low 32 bits of all."""
    return (h >> _U(32)).astype("<u2").tobytes() + h.astype("<u4").tobytes()


def _unpack6(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return (np.frombuffer(b, "<u2", n).astype(_U) << _U(32)) | np.frombuffer(b, "<u4", n, 2 * n).astype(_U)


def _cuts(h: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Where the ranges begin in sorted hashes: 2^bits + 1 places."""
    return np.searchsorted(h >> _U(width - bits), np.arange((1 << bits) + 1).astype(_U))


def level_of(n: np.ndarray) -> np.ndarray:
    """Quantised level of counts from 1 on."""
    return (np.floor(np.log2(np.maximum(n, 1)) * STEPS + 1e-9) + 1).astype(np.uint8)


def value_of(level: np.ndarray) -> np.ndarray:
    """Count that a level stands for (level 0: none): the middle of its counts on the log scale."""
    low = np.ceil(2.0 ** ((level - 1) / STEPS) - 1e-9)
    high = np.maximum(np.ceil(2.0 ** (level / STEPS) - 1e-9) - 1, low)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: ids, (training flag, tokens) of its documents, distinct words, and the tokens' places among them."""
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        train = np.asarray(batch.column(2)).astype("<i8")
        for first, end, data, offsets in c.text_blocks(batch, "text", BLOCK):
            h, at = _tokens(data, offsets)
            words, place = np.unique(h, return_inverse=True)
            docs = np.concatenate([train[first:end], np.diff(at)]).astype("<i8").tobytes()
            lists = [pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), batch.column(i).slice(first, end - first)) for i in (0, 1)]
            tokens = place.astype("<u2" if len(words) <= 65536 else "<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{serial}"]), *lists, *[pa.array([x], pa.binary()) for x in (docs, _pack(words), tokens)]], ["block", "doc_id", "held_out", "docs", "words", "tokens"])
            serial += 1


class _Block:
    """A row of the block table."""

    def __init__(self, docs: bytes, words: bytes, tokens: bytes) -> None:
        self.train, n = np.frombuffer(docs, "<i8").reshape(2, -1)
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.words = _unpack(words)
        self.place = np.frombuffer(tokens, "<u2" if len(tokens) == 2 * self.at[-1] else "<u4")

    def pairs(self) -> np.ndarray:
        """Bigram hash of each token with the one before it; END stands before a document."""
        h = self.words[self.place]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.at[:-1]] = END
        return c.mix(before * _U(0x9E3779B97F4A7C15) + h) >> _U(16)


def _rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[(x.as_py() for x in batch.column(batch.schema.get_field_index(n))) for n in names], strict=True)


_ASKED = "block string, bucket int, words binary, often binary, pairs binary, pair_often binary"


def _asked(bits: int):
    """Of each block: its distinct words and bigrams by hash range, with how often training documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ASKED.split(", ")]
        for batch in batches:
            for name, docs, words, tokens in _rows_of(batch, "block", "docs", "words", "tokens"):
                b = _Block(docs, words, tokens)
                train = np.repeat(b.train.astype(bool), np.diff(b.at))
                often = np.bincount(b.place[train], minlength=len(b.words)).astype("<u4")
                # A bigram's low bit says whether it is one of a training document: sorted, it stands behind the others.
                both, n = np.unique(b.pairs() << _U(1) | train.astype(_U), return_counts=True)
                p = both >> _U(1)
                last = np.flatnonzero(np.concatenate([p[1:] != p[:-1], np.ones(min(len(p), 1), bool)]))
                pair_often = np.where(both[last] & _U(1) == 1, n[last], 0).astype("<u4")
                p = p[last]
                cut, pair_cut = _cuts(b.words, bits), _cuts(p, bits, 48)
                rows = [(name, k, _pack(b.words[s:e]), often[s:e].tobytes(), _pack6(p[u:v]), pair_often[u:v].tobytes()) for k, (s, e, u, v) in enumerate(zip(cut[:-1], cut[1:], pair_cut[:-1], pair_cut[1:], strict=True)) if e > s or v > u]
                block, bucket, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bucket, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]], names)
                c.trim()

    return run


def _totals(keys: list[np.ndarray], often: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and where each given key stands among them."""
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate([np.frombuffer(x, "<u4") for x in often])
    return distinct, np.bincount(back, n, len(distinct)).astype(np.int64), back


def _segment(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """The filter of a range's n-grams, at half of the capacity that the probes are best for: (packed bits, size)."""
    size = 64 * int(np.ceil((levels.sum(dtype=np.int64) + 1) * PROBES * 2 / np.log(2) / 64))
    on = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        item = keys[levels >= level]
        for i in range(PROBES):
            on[_slots(item, level, i, size)] = True
    return np.packbits(on), size


_TOLD = "block string, bucket int, counts binary, word_levels binary, pair_levels binary, tokens long, distinct long, singles long"


def _told(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: exact counts and the filter's levels for what each block has sent, and the range's sums (in the first row)."""
    words, pairs = [_unpack(x) for x in pdf["words"]], [_unpack6(x) for x in pdf["pairs"]]
    w, count, w_back = _totals(words, list(pdf["often"]))
    p, many, p_back = _totals(pairs, list(pdf["pair_often"]))
    grams, seen = np.concatenate([w, p]), np.concatenate([count, many])
    data, size = _segment(grams[seen > 0], level_of(seen[seen > 0]))
    level = _levels(data, size, grams)

    def cut(values: np.ndarray, parts: list[np.ndarray]) -> list[bytes]:
        ends = np.cumsum([0, *map(len, parts)])
        return [values[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]

    first = np.arange(len(pdf)) == 0
    out = pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": cut(count[w_back].astype("<u8"), words), "word_levels": cut(level[: len(w)][w_back], words), "pair_levels": cut(level[len(w) :][p_back], pairs), "tokens": first * int(count.sum()), "distinct": first * int((count > 0).sum()), "singles": first * int((many == 1).sum())})
    del words, pairs, w_back, p_back
    c.trim()
    return out


def _slots(key: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    """Bit of one probe for the item (key, level), in a segment of ``size`` bits."""
    return (c.mix(key * _U(0xA0761D6478BD642F) + _U(level) * _U(0x9E3779B97F4A7C15) + _U(probe * 0x632BE59BD9B4E019 & (2**64 - 1))) % _U(size)).astype(np.int64)


def _levels(data: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Level of each key: probes of 1, 2, ... in the segment until one fails."""
    out = np.zeros(len(keys), np.uint8)
    live, level = np.arange(len(keys)), 1
    while len(live) and level <= 128:
        for i in range(PROBES):
            at = _slots(keys[live], level, i, size)
            live = live[(data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
        out[live] = level
        level += 1
    return out


class Model:
    """Probabilities from levels, with the corpus sizes that smoothing needs."""

    def __init__(self, tokens: int, distinct: int, mix: float) -> None:
        self.tokens, self.distinct, self.mix = tokens, distinct, mix

    def log10(self, word_level: np.ndarray, pair_level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token, from the levels of the token and of its bigram."""
        value = value_of(np.arange(256))
        c_w, c_p = value[word_level], value[pair_level]
        c_v = np.empty(len(c_w))
        c_v[1:] = c_w[:-1]
        c_v[at[:-1]] = c_w[-1]  # the last token is an END
        p_w = (c_w + 1) / (self.tokens + self.distinct + 1)
        seen = (c_p > 0) & (c_v > 0) & (c_w > 0)  # a pair cannot be without its words
        ratio = np.minimum(c_p / np.maximum(c_v, 1), 1.0)
        return np.log10(np.where(c_v > 0, np.where(seen, self.mix * ratio, 0.0) + (1 - self.mix) * p_w, p_w))


def _scored_block(model: Model):
    """Of one block: sums and scores of its documents, from what the ranges have told."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        b = _Block(*(rows[n][0].as_py() for n in ("docs", "words", "tokens")))
        told = told.sort_by("bucket")
        join = lambda n, kind: np.frombuffer(b"".join(told[n].to_pylist()), kind)
        count, w_level, p_level = join("counts", "<u8")[b.place], join("word_levels", np.uint8), join("pair_levels", np.uint8)
        _, which = np.unique(b.pairs(), return_inverse=True)
        each = lambda x: np.add.reduceat(x, b.at[:-1])
        logp = model.log10(w_level[b.place], p_level[which], b.at)
        flat = [rows[n].combine_chunks().flatten() for n in ("doc_id", "held_out")]
        return pa.table({"doc_id": flat[0], "held_out": flat[1], "n_tokens": pa.array(np.diff(b.at), pa.int64()), "n_known": pa.array(each((count > 0).astype(np.int64))), "logs": pa.array(each(np.log10(count + 1.0))), "score": pa.array(each(logp))})

    return run


def score_documents(docs: DataFrame, mix: float | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs(doc_id, text, held_out)``."""
    spark = docs.sparkSession
    c.small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    train = (F.col("doc_id").isNotNull() & ~F.col("held_out")).cast("int")
    slim = docs.select("doc_id", "held_out", train.alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = max(5, (c.shuffle_partitions(spark) - 1).bit_length())
    blocks = c.materialize(slim.mapInArrow(_split, f"block string, doc_id array<{kind}>, held_out array<boolean>, docs binary, words binary, tokens binary"), "blocks")
    told = c.materialize(blocks.select("block", "docs", "words", "tokens").mapInArrow(_asked(bits), _ASKED).groupBy("bucket").applyInPandas(_told, _TOLD), "told")
    c.release(spark)  # what the blocks have asked, the largest shuffle, goes before the answers are shuffled
    n = told.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "distinct", "singles")]).first()
    if mix is None:
        mix = min(0.95, max(0.05, 1 - n["singles"] / n["tokens"])) if n["tokens"] else 0.5
    model = Model(n["tokens"], n["distinct"], mix)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    answers = told.select("block", "bucket", "counts", "word_levels", "pair_levels")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored_block(model), out)
    unit = F.log10(F.lit(float(n["tokens"] + n["distinct"] + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n["tokens"]).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * unit).alias("base_score"), "score")


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return score_documents(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")))
