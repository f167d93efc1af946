"""Operator 13: cross-tokenizer alignment by per-byte label strings.

Space + text is encoded by two tokenizers. Each of its bytes gets a label: ``.`` (no
token ends there), ``a`` (one of A does), ``b`` (one of B does) or ``x`` (both do). The regular
expression ``[^x]*x`` scans the label string; the labels of each span count
the tokens of each side in that group. A label string is that of the text's units one
after the other (``units``: all units end in ``x``), so each distinct unit is labelled and scanned once.

The tokens that end a group are a link. The shorter one's bytes are a suffix of the longer
one's, so the pairs that can be linked at all are a matter of the two vocabularies
(``pairs_of``: fewer than all suffixes of all tokens, some hundred thousand), whatever
the corpus. Counts of links corpus-wide are therefore an array of proven size: tasks
sum their own, a shuffle adds them up, and they are broadcast to the aligned documents, which
stand in a table of the shared folder with one number a distinct link.

Defined results: null and empty texts, and texts whose joined token bytes on either side are not space +
text (as with the mark that B has for a space), have no tokens; special strings inside texts are plain text;
repeated rows count as often as they stand there; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _common as c
from .bpe_codec import default_path
from .units import ByteLevel, Ragged, Units, blocks

#: Label of a byte by (A ends there) + 2 x (B ends there).
LABELS = np.frombuffer(b".abx", np.uint8)
_GROUP = re.compile(rb"[^x]*x")
#: Texts that are labelled at a time.
_AT_ONCE = 20_000


class Aligner:
    """Two tokenizers, A byte-level and B of sentence pieces, and the alignment of their tokens."""

    def __init__(self, a_raw: bytes, b_raw: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self._a = ByteLevel(a_raw, special=False)
        self.a, self.a_bytes = self._a.library, self._a.bytes
        self.b = SentencePieceProcessor(model_proto=b_raw)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self._a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self._b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.pairs = self._pairs()
        self._units = Units(self._learn, " ")
        self._forget()

    def _pairs(self) -> np.ndarray:
        """Sorted a << 32 | b of all pairs of which one's bytes are a suffix of the other's."""
        by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
        for known, tokens in zip(by_bytes, (self.a_bytes, self.b_bytes), strict=True):
            for i, x in enumerate(tokens):
                if x:
                    known.setdefault(x, []).append(i)
        found = set()
        for i, x in enumerate(self.a_bytes):
            found.update(i << 32 | j for k in range(len(x)) for j in by_bytes[1].get(x[k:], ()))
        for j, x in enumerate(self.b_bytes):
            found.update(i << 32 | j for k in range(len(x)) for i in by_bytes[0].get(x[k:], ()))
        return np.array(sorted(found), np.int64)

    def _forget(self) -> None:
        self._links = Ragged(np.int32)
        self._links.add(np.zeros(0, np.int32), np.zeros(1, np.int64))
        self._table = Ragged(np.int64)  # four numbers a unit: A's tokens, B's tokens, groups, whether the bytes are right
        self._table.add(np.array([0, 0, 0, 1], np.int64), np.array([4]))
        self._groups = [""]

    def _learn(self, texts: list[str]) -> None:
        for first in range(0, len(texts), _AT_ONCE):
            self._learn_some(texts[first : first + _AT_ONCE])

    def _learn_some(self, texts: list[str]) -> None:
        flat, sizes = self._a.encode(texts)
        a = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)  # the library puts the space there itself
        raw = [t.encode() for t in texts]
        whole = [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw, strict=True)]
        right = [i for i, w in enumerate(whole) if w]
        a_ids = np.array([t for i in right for t in a[i]], np.int64)
        b_ids = np.array([t for i in right for t in b[i]], np.int64)
        size = np.array([len(raw[i]) for i in right], np.int64)
        a_end, b_end = np.cumsum(self._a_len[a_ids]), np.cumsum(self._b_len[b_ids])
        ends = np.zeros(int(size.sum()), np.uint8)
        ends[a_end - 1] += 1
        ends[b_end - 1] += 2
        labels = LABELS[ends].tobytes()

        end = np.array([m.end() for m in _GROUP.finditer(labels)], np.int64)
        a_upto, b_upto = (np.searchsorted(x, end, "right") for x in (a_end, b_end))
        link = np.searchsorted(self.pairs, a_ids[a_upto - 1] << 32 | b_ids[b_upto - 1]).astype(np.int32)
        # Groups as text; one token on both sides is the usual case.
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        groups, i, j = [], 0, 0
        for m, n in zip(a_upto.tolist(), b_upto.tolist(), strict=True):
            groups.append(f"{a_text[i] if m == i + 1 else ','.join(a_text[i:m])}|{b_text[j] if n == j + 1 else ','.join(b_text[j:n])}")
            i, j = m, n
        upto = np.searchsorted(end, np.cumsum(size), "right")
        n_groups = np.diff(upto, prepend=0)
        table = np.zeros((len(texts), 4), np.int64)
        texts_of, at = [""] * len(texts), 0
        for i, n in zip(right, n_groups.tolist(), strict=True):
            table[i] = len(a[i]), len(b[i]), n, 1
            texts_of[i] = ";".join(groups[at : at + n])
            at += n
        self._groups += texts_of
        self._links.add(link, table[:, 2].copy())
        self._table.add(table.ravel(), np.full(len(texts), 4))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of A, of B and groups by text; groups as strings; distinct links, their times, offsets by text)."""
        self._units.forget_if_full(self._forget)
        rows, at = self._units.of(texts)
        table = self._table.pool.data.reshape(-1, 4)
        sums = np.zeros((len(rows) + 1, 4), np.int64)
        np.cumsum(table[rows], axis=0, out=sums[1:])
        found = sums[at[1:]] - sums[at[:-1]]
        right = found[:, 3] == np.diff(at)
        found[~right] = 0
        names = list(map(self._groups.__getitem__, rows.tolist()))
        groups = [";".join(names[s:e]) if ok else "" for s, e, ok in zip(at[:-1].tolist(), at[1:].tolist(), right.tolist(), strict=True)]
        kept = np.repeat(right, np.diff(at))
        links, by_unit = self._links.take(rows)
        owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(at)), np.diff(by_unit))
        if not kept.all():
            fine = np.repeat(kept, np.diff(by_unit))
            links, owner = links[fine], owner[fine]
        keys, times = np.unique(owner << 32 | links, return_counts=True)
        offsets = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
        return found[:, :3], groups, (keys & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32), offsets.astype(np.int32)


_loaded: dict[str, Aligner] = {}


def aligner_of(a_raw: bytes, b_raw: bytes) -> Aligner:
    key = hashlib.sha256(a_raw).hexdigest() + hashlib.sha256(b_raw).hexdigest()
    if key not in _loaded:
        _loaded[key] = Aligner(a_raw, b_raw)
    return _loaded[key]


def _files(a_path: str | None, b_path: str | None) -> list[bytes]:
    out = []
    for path, name in ((a_path, "byte_bpe_50k.json"), (b_path, "piece_bpe_32k.model")):
        with open(path or default_path(name), "rb") as f:
            out.append(f.read())
    return out


def _aligned(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner_of(*raw.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in blocks(batch):
                found, groups, links, times, offsets = model.align(texts)
                columns = [ids.slice(first, last - first), *[pa.array(found[:, k]) for k in (0, 1, 2, 2)], pa.array(groups, pa.string())]
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (links, times)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"])
            c.trim()

    return run


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links, times) of every document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and B in order. ``links`` are the distinct links
    as places in ``pairs_of``, ``times`` how often each stands in the document.
    """
    spark = docs.sparkSession
    c.small_batches(spark)
    raw = spark.sparkContext.broadcast(_files(a_path, b_path))  # the tokenizers' files
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups string, links array<int>, times array<int>")
    return rows.mapInArrow(_aligned(raw), StructType([rows.schema["doc_id"], *made.fields]))


def pairs_of(a_path: str | None = None, b_path: str | None = None) -> np.ndarray:
    """a << 32 | b of every pair that can be linked, in order."""
    return aligner_of(*_files(a_path, b_path)).pairs


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        links, times = (batch.column(batch.schema.get_field_index(k)).flatten().to_numpy(zero_copy_only=False) for k in ("links", "times"))
        if len(links):
            more = np.bincount(links, weights=times)  # exact below 2^53
            if len(more) > len(total):
                total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
            total[: len(more)] += more.astype(np.int64)
    at = np.flatnonzero(total)
    for first in range(0, max(1, len(at)), 50_000):
        some = at[first : first + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["link", "n"])


def link_counts(aligned: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(link, a, b, n, best) corpus-wide: how often the pair is linked, and whether no other id of A is linked to b more often."""
    spark = aligned.sparkSession
    pairs = pairs_of(a_path, b_path)
    names = spark.createDataFrame(pa.table({"link": np.arange(len(pairs), dtype=np.int32), "a": pairs >> 32, "b": pairs & 0xFFFFFFFF}))
    sums = aligned.select("links", "times").mapInArrow(_summed, "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))
    return sums.join(names, "link").withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _scored(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = counts.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("links"))
            links, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column(batch.schema.get_field_index("times")).flatten().to_numpy(zero_copy_only=False)
            at = np.zeros(batch.num_rows + 1, np.int64)
            np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), out=at[1:])
            out = []
            for values in (times * best[links], times * n[links]):
                sums = np.zeros(len(values) + 1, np.int64)
                np.cumsum(values, out=sums[1:])
                out.append(pa.array(sums[at[1:]] - sums[at[:-1]]))
            kept = [k for k in batch.schema.names if k not in ("links", "times")]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in kept], *out], [*kept, "n_best", "count_sum"])

    return run


def scored_documents(aligned: DataFrame, counts: DataFrame, n_pairs: int) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of its links; ``counts`` has fewer rows than there are pairs."""
    spark = aligned.sparkSession
    rows = counts.select("link", "n", "best").toArrow()
    n, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    at = rows["link"].to_numpy()
    n[at], best[at] = rows["n"].to_numpy(), rows["best"].to_numpy()
    sent = spark.sparkContext.broadcast((n, best))
    fields = [f for f in aligned.schema if f.name not in ("links", "times")]
    return aligned.mapInArrow(_scored(sent), StructType([*fields, *StructType.fromDDL("n_best long, count_sum long").fields]))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    aligned = align_documents(c.table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = c.materialize(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links", "times"), "aligned")
    return scored_documents(aligned, link_counts(aligned), len(pairs_of())).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
