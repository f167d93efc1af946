"""Operator 11: packing token sequences by harmonic classes.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths above
capacity / (k + 1) and up to capacity / k, and each of its bins takes k pieces, whatever
their lengths. A document is cut first: whole sequences, then what is left over, of which
the largest slot of a class (capacity // k ids) is cut off until a bin of what is left would be
padded by no more than ``slack`` ids; slots that waste more are passed over. Each task fills the bins of its own
documents; nothing is shuffled, and a task holds at most one open bin a class. What is left in
open bins at the task's end is poured into whole sequences, the last of which is
split into powers of two, which are not padded.

Sequence ids are the task's number and a counter, so a task that runs again gives
the same rows as long as its input rows come in the same order, as they do from files.
Other file splits give other sequences of the same documents.

Defined results: null and empty texts are the id 0 alone; special strings in a text are special tokens,
as in the library; repeated rows and null ids are documents of their own; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from .bpe_codec import default_path
from .units import ByteLevel, Ragged, Units, blocks

#: Ids of a sequence.
CAPACITY = 1024
#: Ids that a bin of equal pieces may be padded by before they are cut.
SLACK = 8


class ByteBpe:
    """Ids of texts as the tokenizers library gives them, each distinct unit encoded once."""

    def __init__(self, raw: bytes, special: bool = True) -> None:
        self._bpe = ByteLevel(raw, special)
        self.library = self._bpe.library
        self._units = Units(self._learn, "")
        self._forget()

    def _forget(self) -> None:
        self._ids = Ragged(np.uint32)
        self._ids.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _learn(self, texts: list[str]) -> None:
        for first in range(0, len(texts), 20_000):
            self._ids.add(*self._bpe.encode(texts[first : first + 20_000]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        self._units.forget_if_full(self._forget)
        rows, at = self._units.of(texts)
        flat, by_unit = self._ids.take(rows)
        return flat, by_unit[at]


_loaded: dict[str, ByteBpe] = {}


def model_of(raw: bytes) -> ByteBpe:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded[key] = ByteBpe(raw)
    return _loaded[key]


def cuts(length: int, capacity: int, slack: int) -> list[int]:
    """Lengths of the pieces of a rest of fewer than ``capacity`` ids."""
    def fits(n: int) -> bool:
        return capacity % n <= slack  # a bin of class capacity // n

    out = []
    while length:
        out.append(next(n for k in range(capacity // length, capacity + 1) if fits(n := length if k == capacity // length else capacity // k)))
        length -= out[-1]
    return out


class Packer:
    """Bins of one task. Pieces are (owner, start, ids, owner's ids)."""

    def __init__(self, capacity: int, slack: int, first_id: int) -> None:
        self._capacity, self._next = capacity, first_id
        self._cuts = [cuts(n, capacity, slack) for n in range(capacity)]
        self._open: dict[int, list] = {}
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for owner, start, ids, total in pieces:
            self.done.append((owner, start, len(ids), total, self._next, offset, ids.tobytes()))
            offset += len(ids)
        self._next += 1

    def add(self, owner, ids: np.ndarray) -> None:
        """Cut a document and put its pieces into the bins of their classes."""
        size, at = self._capacity, 0
        whole, rest = divmod(len(ids), size)
        for n in [size] * whole + self._cuts[rest]:
            k = size // n
            bin_ = self._open.setdefault(k, [])
            bin_.append((owner, at, ids[at : at + n].copy(), len(ids)))
            if len(bin_) == k:
                self._close(self._open.pop(k))
            at += n

    def finish(self) -> None:
        """Pour what open bins hold into whole sequences, the last one into powers of two."""
        line = [p for k in sorted(self._open) for p in self._open[k]]
        self._open.clear()
        left = sum(len(p[2]) for p in line)
        room = min(self._capacity, left)
        if left and room < self._capacity:
            room = 1 << (left.bit_length() - 1)
        bin_ = []
        for owner, start, ids, total in line:
            while len(ids):
                n = min(room, len(ids))
                bin_.append((owner, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self._close(bin_)
                    bin_ = []
                    room = self._capacity if left >= self._capacity else 1 << max(0, left.bit_length() - 1)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def _packed(raw, capacity: int, slack: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(raw.value)
        packer = Packer(capacity, slack, TaskContext.get().partitionId() << 32)
        end = np.zeros(1, np.uint32)

        def rows() -> pa.RecordBatch:
            made = packer.take()
            columns = zip(*made, strict=True) if made else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            owners = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, texts in blocks(batch):
                ids, at = model.encode(texts)
                for i, owner in enumerate(owners.slice(first, last - first).to_pylist()):
                    packer.add(owner, np.concatenate([ids[at[i] : at[i + 1]], end]))
                yield rows()
            c.trim()
        packer.finish()
        yield rows()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece; ids are little-endian unsigned 32-bit."""
    spark = docs.sparkSession
    c.small_batches(spark)
    with open(path or default_path("byte_bpe_50k.json"), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # a tokenizer's file
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), *[(k, pa.int64()) for k in ("start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])
    made = f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return rows.mapInArrow(_packed(raw, capacity, slack, schema), made)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(c.table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
