"""Operator 7: dedup of long repeated byte strings.

Suffixes are compared on their first ``length`` bytes only, so a position is
*repeated* when its ``length``-byte prefix also starts anywhere else. The dealt
method, a distributed difference cover, sorts every byte position several times
and does not fit the disk limit (README, op7). This is another method, by
content-chosen anchors and grouping by hash; it keeps the property on which the
difference cover rests - two equal strings hold a sampled position at the same
offset - at one sample in about two fifths of ``length``:

1. *Anchors*: the leftmost minimum of the hashed k-tuples in each string of
   ``length`` bytes is its anchor, named by its k-tuple. An anchor whose name is
   unique ends all strings that hang on it, and goes no further.
2. *Whole windows*: the others are grouped by all bytes of the windows that hang
   on an anchor; copies are settled here.
3. *Cores*: what is left is grouped by the bytes that 32 neighbouring suffixes of
   an anchor share (core) and the 31 + 31 bytes around them (context); equal (core,
   context) settle 32 suffixes at once, a core with one context settles them too.
4. *Single suffixes*: the others are grouped by (core, offset, context bytes).
   The union of the bytes of the repeated strings is what is removed.

Longer strings are searched only within what a shorter length has found: each
string of 400 bytes that repeats lies, at both places, within a run of bytes that
repeated strings of 240 bytes cover.

Grouping is by content hash with partial counts, so copies of one passage, be
they a third of all rows, are pre-aggregated; the rows of one anchor name, one a
block of text, still meet in one task where they are joined with their count.

Defined results: null text is empty; texts shorter than ``length`` keep all;
repeated rows count as repetitions of each other; copies are all removed. Passages
(``without_repeats``, ``passage_bytes``) are runs of 240-byte strings that hold more
than 50 words. Where
texts are returned, a removed run keeps the characters that its ends would split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

_U = np.uint64
#: Suffixes that one core stands for.
SPAN = 32
#: Bytes of a repeated string; bytes that a repeated passage has at least, and words that it has more than.
LENGTH, PASSAGE, PASSAGE_WORDS = 400, 240, 50
#: A text is named by two hashes and, if it is a part of one, by its place in it.
KEYS = ("k1", "k2", "k3")
_KEYS = "k1 long, k2 long, k3 int"


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of the top 32 bits in each window of h."""
    n = len(h)
    key = (h & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    pad = (-n) % width
    rows = np.concatenate([key, np.full(pad, (1 << 64) - 1, _U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & _U(0xFFFFFFFF)).astype(np.int64)


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(anchor, first and last start of its windows, document ordinal, k-tuple name, hashes) of a block."""
    size = np.diff(offsets)
    if not (size >= length).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(_U), None
    roll = c.Rolling(data)
    h = roll.every(k)
    at = _least(h, length - k + 1)
    valid = np.zeros(len(at), bool)  # a window starts here and ends in the same document
    for d in np.flatnonzero(size >= length):
        valid[offsets[d] : offsets[d + 1] - length + 1] = True
    starts = np.ones(len(at), bool)
    starts[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    starts &= valid
    ends = valid.copy()
    ends[:-1] &= starts[1:] | ~valid[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    q = at[first]
    return q, first, last, np.searchsorted(offsets, first, "right") - 1, h[q], roll


def _heads(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _lists(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)).astype(np.int32)), pa.array(values))


#: Odd multipliers that name a context.
_PLACES = c.mix(np.arange(1, 2 * SPAN - 1, dtype=_U)) | _U(1)


def _names(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in range(3)]
            for first, _, data, offsets in c.text_blocks(batch, "text"):
                q, begin, last, doc, name, roll = anchors_of(data, offsets, length, k)
                if len(q):
                    # All bytes of the windows that hang on the anchor, and where it stands in them.
                    whole = c.mix(roll.of(begin, last + length) + (q - begin).astype(_U))
                    order = np.lexsort((whole, name, doc))
                    name, whole, doc, q, begin, last = (x[order] for x in (name, whole, doc, q, begin, last))
                    head = _heads(name, whole, doc)
                    d = doc[head]
                    back = (q - begin)[head].astype(np.int16)
                    more = (last - begin)[head].astype(np.int16)
                    yield pa.RecordBatch.from_arrays([pa.array(name[head].view(np.int64)), pa.array(whole[head].view(np.int64)), *[pa.array(x[first + d]) for x in keys], _lists((q - offsets[doc]).astype(np.int32), head), pa.array(back), pa.array(more)], ["name", "whole", *KEYS, "at", "back", "more"])

    return run


_CORES = f"{_KEYS}, starts array<int>, name long, core long, way long, low int, high int, context binary"


def _cores(length: int, k: int):
    """For the anchors that others share: cores, contexts and the suffixes they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in range(3)]
            shared = batch.column(batch.schema.get_field_index("anchors"))
            for first_row, end_row, data, offsets in c.text_blocks(batch, "text"):
                q, first, last, doc, name, roll = anchors_of(data, offsets, length, k)
                if not len(q):
                    continue
                mine = shared.slice(first_row, end_row - first_row)
                flat = np.asarray(mine.flatten()).astype(np.int64)
                counts = np.asarray(mine.value_lengths().fill_null(0))
                wanted = flat + np.repeat(offsets[:-1], counts)
                keep = np.isin(q, wanted)
                q, first, last, doc, name = q[keep], first[keep], last[keep], doc[keep], name[keep]
                low, high = q - last, q - first  # offsets of the anchor in its windows
                each = high // SPAN - low // SPAN + 1
                a = np.repeat(np.arange(len(q)), each)
                step = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
                bin_ = low[a] // SPAN + step
                lo, hi = np.maximum(low[a], bin_ * SPAN) - bin_ * SPAN, np.minimum(high[a], bin_ * SPAN + SPAN - 1) - bin_ * SPAN
                start = q[a] - bin_ * SPAN
                stop = start - (SPAN - 1) + length
                core = c.mix(roll.of(start, stop) + bin_.astype(_U))
                around = np.arange(SPAN - 1)
                places = np.concatenate([start[:, None] - (SPAN - 1) + around, stop[:, None] + around], axis=1)
                d = doc[a]
                within = (places >= offsets[d][:, None]) & (places < offsets[d + 1][:, None])
                context = np.where(within, data[np.clip(places, 0, len(data) - 1)], 0).astype(np.uint8)
                way = c.mix((context * _PLACES).sum(axis=1, dtype=_U) + lo.astype(_U) * _U(1 << 40) + hi.astype(_U) * _U(1 << 50))
                # Periodic text brings the same core many times in one document: one row, with all starts.
                order = np.lexsort((way, core, d))
                head = _heads(d[order], core[order], way[order])
                one = order[head]
                wide = 2 * (SPAN - 1)
                around = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer((np.arange(len(one) + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(context[one]))])
                starts = _lists((start - offsets[d])[order].astype(np.int32), head)
                cols = [name[a].view(np.int64), core.view(np.int64), way.view(np.int64), lo.astype(np.int32), hi.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x[first_row + d[one]]) for x in keys], starts, *[pa.array(x[one]) for x in cols], around], [x.split()[0] for x in _CORES.split(", ")])

    return run


def covered(n: int, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that strings of this length, starting there, cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), np.minimum(starts[np.append(cut, len(starts) - 1)] + length, n).tolist(), strict=True))


def _spans(length: int):
    """The maximal runs that the repeated strings of each text cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(SPAN)
        for batch in batches:
            texts, found, wholes = (batch.column(batch.schema.get_field_index(x)) for x in ("text", "marks", "wholes"))
            spans = []
            for i in range(batch.num_rows):
                marks = found.slice(i, 1).flatten()
                start = np.asarray(marks.field("starts").flatten()).astype(np.int64)
                mask = np.repeat(np.asarray(marks.field("mask")).astype(np.int64), np.asarray(marks.field("starts").value_lengths()))
                r, b = np.nonzero((mask[:, None] >> bits) & 1)
                ranges = wholes.slice(i, 1).flatten()
                at = np.asarray(ranges.field("at").flatten()).astype(np.int64)
                n_at = np.asarray(ranges.field("at").value_lengths())
                begin = at - np.repeat(np.asarray(ranges.field("back")).astype(np.int64), n_at)
                size = np.repeat(np.asarray(ranges.field("more")).astype(np.int64), n_at) + 1
                in_range = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
                raw = memoryview(texts[i].as_buffer())
                spans.append([{"start": s, "end": e, "words": len(_WORD.findall(raw[s:e]))} for s, e in covered(len(raw), np.concatenate([start[r] - b, in_range]), length)])
            kept = [i for i, x in enumerate(spans) if x]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(kept, pa.int64())) for k in range(3)], texts.take(pa.array(kept, pa.int64())), pa.array([spans[i] for i in kept], _SPANS)], [*KEYS, "text", "spans"])

    return run


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
_FOUND = f"{_KEYS}, text binary, spans array<struct<start:int,end:int,words:int>>"


def repeated_spans(texts: DataFrame, length: int, k: int = 0) -> DataFrame:
    """The rows of ``texts(k1, k2, k3, text)`` (bytes) that hold repeated strings, with the ``spans`` that these cover: a table. Repeated rows are in it as often."""
    k = k or length // 5
    c.small_batches(texts.sparkSession)
    keys = list(KEYS)
    long = texts.select(*keys, "text").where(F.octet_length("text") >= length)
    names = c.materialize(long.mapInArrow(_names(length, k), f"name long, whole long, {_KEYS}, at array<int>, back short, more short"), "names")
    # The small side has one short row a name, so it is hashed rather than both sides sorted.
    several = names.groupBy("name").agg(F.sum(F.size("at")).alias("total")).where("total > 1").select("name")
    shared = c.materialize(names.join(several.hint("shuffle_hash"), "name"), "shared")
    c.discard(names)
    # Per (name, all bytes around): how often; per name: in how many ways.
    counts = c.materialize(shared.groupBy("name", "whole").agg(F.sum(F.size("at")).alias("n"), F.min(F.struct(*keys)).alias("lead")), "counts")
    state = counts.join(counts.groupBy("name").agg(F.count("*").alias("m")), "name").select("name", "whole", "n", "m", "lead")
    placed = shared.join(state, ["name", "whole"])
    is_open = (F.col("m") > 1) & ((F.col("n") == 1) | (F.col("lead") == F.struct(*keys)))
    ranges = F.when(F.col("n") > 1, F.struct("at", "back", "more"))
    placed = placed.groupBy(*keys).agg(F.flatten(F.collect_list(F.when(is_open, F.col("at")))).alias("anchors"), F.collect_list(ranges).alias("wholes"))
    # Tables of their own, so that what they are made of can go before texts are moved.
    placed = c.materialize(placed.where((F.size("anchors") > 0) | (F.size("wholes") > 0)), "placed")
    c.discard(shared, counts)
    suspects = c.materialize(long.join(placed, keys), "suspects")
    c.discard(placed)
    unsettled = suspects.where(F.size("anchors") > 0)
    cores = c.materialize(unsettled.mapInArrow(_cores(length, k), _CORES), "cores")

    ways = cores.groupBy("name", "core", "way", "low", "high", "context").agg(F.sum(F.size("starts")).alias("n"))
    ways = c.materialize(ways, "ways")
    open_ = ways.groupBy("name", "core").agg(F.count("*").alias("m")).where("m > 1").select("name", "core")
    whole = ways.where("n > 1").select("name", "core", "way", F.expr("shiftleft(1L, high + 1) - shiftleft(1L, low)").alias("mask"))
    single = ways.join(open_, ["name", "core"]).select("name", "core", "way", "n", F.explode(F.sequence("low", "high")).alias("i"), "context")
    # Suffix i of a core: the last i bytes before it and the first 31 - i after it.
    prefix = F.expr(f"substring(context, {SPAN} - i, {SPAN - 1})")
    single = single.select("name", "core", "way", "n", "i", F.xxhash64("i", prefix).alias("suffix"))
    alike = single.groupBy("name", "core", "suffix").agg(F.sum("n").alias("s")).where("s > 1").select("name", "core", "suffix")
    part = single.where("n = 1").join(alike, ["name", "core", "suffix"]).groupBy("name", "core", "way").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))
    masks = whole.unionAll(part)
    marks = cores.select(*keys, "starts", "name", "core", "way").join(masks, ["name", "core", "way"]).groupBy(*keys).agg(F.collect_list(F.struct("starts", "mask")).alias("marks"))
    marks = c.materialize(marks, "marks")
    c.discard(cores, ways)
    none = F.array().cast("array<struct<starts:array<int>,mask:bigint>>")
    settled = suspects.where(F.size("anchors") == 0).select(*keys, "text", "wholes", none.alias("marks"))
    ended = unsettled.select(*keys, "text", "wholes").join(marks, keys, "left").select(*keys, "text", "wholes", F.coalesce("marks", none).alias("marks"))
    found = c.materialize(settled.unionAll(ended).mapInArrow(_spans(length), _FOUND), "spans")
    c.discard(suspects, marks)
    return found


def longer_spans(found: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spans) of the longer strings that repeat, from what a shorter length has found."""
    run = F.col("span.end") - F.col("span.start")
    runs = found.select("k1", "k2", "text", F.explode("spans").alias("span")).where(run >= length)
    runs = runs.select("k1", "k2", F.col("span.start").alias("k3"), F.substring(F.col("text"), F.col("span.start") + 1, run).alias("text"))
    # Equal runs repeat as a whole: one of each is searched for what it shares with others.
    runs = runs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text", F.octet_length("text"))})
    same = runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "k3")).alias("lead"))
    runs = c.materialize(runs.join(same, ["h1", "h2"]).select("k1", "k2", "k3", "n", (F.col("lead") == F.struct("k1", "k2", "k3")).alias("leads"), F.octet_length("text").alias("size"), F.when(F.col("lead") == F.struct("k1", "k2", "k3"), F.col("text")).alias("text")), "runs")
    whole = runs.where("n > 1").select("k1", "k2", "k3", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"), F.lit(0).alias("words"))).alias("spans"))
    again = repeated_spans(runs.where("leads").dropDuplicates(["k1", "k2", "k3"]).select("k1", "k2", "k3", "text"), length)
    again = whole.unionByName(again.select("k1", "k2", "k3", "spans").join(whole.select("k1", "k2", "k3").distinct(), ["k1", "k2", "k3"], "left_anti"))
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("k3")).alias("start"), (x["end"] + F.col("k3")).alias("end")))
    return again.select("k1", "k2", "k3", moved.alias("spans")).groupBy("k1", "k2").agg(F.flatten(F.array_sort(F.collect_set(F.struct("k3", "spans")))["spans"]).alias("spans"))


def _kept(with_text: bool):
    """What is left of each text without its spans; whole characters where the text itself is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = (batch.column(batch.schema.get_field_index(x)) for x in ("text", "spans"))
            rows = []
            for i in range(batch.num_rows):
                raw, at, kept, removed, n = texts[i].as_py(), 0, [], 0, 0
                mine = spans.slice(i, 1).flatten()
                for s, e in zip(mine.field("start").to_pylist(), mine.field("end").to_pylist(), strict=True):
                    if with_text:
                        while s < len(raw) and raw[s] & 0xC0 == 0x80:
                            s += 1
                        while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
                            e -= 1
                    if s < e:
                        kept.append(raw[at:s])
                        at, removed, n = e, removed + e - s, n + 1
                kept = b"".join([*kept, raw[at:]])
                rows.append((removed, n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def kept_texts(found: DataFrame, with_text: bool = False) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256, kept) of ``found(k1, k2, text, spans)``."""
    return found.select("k1", "k2", "text", "spans").mapInArrow(_kept(with_text), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64("doc_id", text), "k2": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), "k3": F.lit(0)})


def _texts(docs: DataFrame) -> DataFrame:
    return _keyed(docs).select(*KEYS, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def passage_spans(words: int = PASSAGE_WORDS) -> Column:
    """The spans of more than so many words."""
    return F.filter("spans", lambda x: x["words"] > words)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Besides the strings of 400 bytes, the bytes and runs of repeated passages of over 50 words."""
    docs = c.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = repeated_spans(_texts(docs), PASSAGE)
    strings = longer_spans(found, LENGTH)
    passages = found.withColumn("spans", passage_spans())
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    about = passages.select("k1", "k2", length.alias("passage_bytes"), F.size("spans").cast("long").alias("n_passages")).dropDuplicates(["k1", "k2"])
    found = kept_texts(passages.select("k1", "k2", "text").join(strings, ["k1", "k2"])).drop("kept").dropDuplicates(["k1", "k2"])
    every = _keyed(docs).select("doc_id", "k1", "k2", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    zero = F.lit(0).cast("long")
    joined = every.join(about.join(found, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    counts = [F.coalesce(x, zero).alias(x) for x in ("n_removed", "n_spans")]
    return joined.select("doc_id", "n_bytes", *counts, F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *[F.coalesce(x, zero).alias(x) for x in ("passage_bytes", "n_passages")])


def without_repeats(docs: DataFrame, length: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with the repeated passages of more than ``words`` words cut from the texts; a document that loses its whole text goes."""
    found = repeated_spans(_texts(docs), length).withColumn("spans", passage_spans(words)).where(F.size("spans") > 0)
    kept = kept_texts(found, with_text=True).where("n_removed > 0").select("k1", "k2", "kept").dropDuplicates(["k1", "k2"])
    rows = _keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text")).select("row", "k1", "k2").join(kept, ["k1", "k2"], "left")
    rows = rows.where(F.col("kept").isNull() | (F.length("kept") > 0))
    text = F.coalesce("kept", F.col("row.text"))
    made = {"text": text} | ({"n_chars": F.coalesce(F.length("kept").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return rows.select(*[made.get(n, F.col("row").getField(n)).alias(n) for n in docs.columns])
