"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.session import ship
from termloom.sources.tables import shared_dir

#: Odd multiplier of the polynomial hash and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64

#: Bytes of text that one vectorised step handles at most (one longer document
#: is a step of its own).
BLOCK_BYTES = 1 << 18
#: Bytes of an Arrow batch at most, below a power of two as buffers are rounded up to one.
BATCH_BYTES = 900_000


#: Bytes of tables after which shuffle files are looked after; what smaller tables left behind can wait.
RELEASE_BYTES = 4 << 20
_written = 0


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors.
    """
    global _written
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    system, at = _file_system(spark, path)
    _written += system.getContentSummary(at).getLength()
    if _written >= RELEASE_BYTES:
        _written = 0
        release(spark)
    table_ = spark.read.schema(schema).parquet(path)
    table_._written_to = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for t in tables:
        system, at = _file_system(t.sparkSession, t._written_to)
        system.delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan needs any more (it does so when the driver collects garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that one Arrow batch carries to a Python worker (a longer row is a batch of its own); the workers get this package.

    The bound is a setting of the session; it limits memory and changes no result.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give freed memory back to the system: workers live on, side by side with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (two xor-shift-multiply rounds)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size > 4 * BLOCK_BYTES:  # one very long document: not worth keeping
        size = n + 1
    if size not in _powers:
        made = []
        for base in (_BASE, _INV):
            p = np.full(size, base, _U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * BLOCK_BYTES:
            return made[0], made[1]
        _powers.clear()
        _powers[size] = (made[0], made[1])
    return _powers[size]


class Rolling:
    """Polynomial hashes modulo 2^64 of every substring of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power, self._inverse = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])

    def every(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes, by start."""
        s = self._sums
        return mix((s[k:] - s[: len(s) - k]) * self._inverse[: len(s) - k])


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string column; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary()) if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, limit = 0, limit or BLOCK_BYTES
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
        trim()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document in a block, A-Z lower-cased.

    Returns (hash, document ordinal, start, end); words never cross documents.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z, z, z
    low = _LOWER[data]
    word = ~_BLANK[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    return Rolling(low).of(start, end), owner, start, end


def connected(links: DataFrame, name: str) -> DataFrame:
    """Smallest id reachable, for every node of ``links(a, b)``: (node, label).

    Min-label hooking with pointer jumping on DataFrames; each round is a table
    in the shared folder, and the number of rounds is logarithmic for the star
    and path shapes that the callers make.
    """
    edges = links.where("a <> b")
    edges = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(edges, f"{name}-edges")
    table_ = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-0")
    for i in range(1, 64):
        labels = table_.select("node", "label")
        pulled = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hooked = labels.join(pulled, "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = hooked.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("changed"))
        moved = materialize(moved, f"{name}-{i}")
        discard(table_)
        table_ = moved
        if moved.where("changed").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    discard(edges)
    return table_.select("node", "label")
