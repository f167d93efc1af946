"""Operator 9: n-gram Jaccard join by a grouped prefix join.

A document's set holds its distinct word 5-shingles as 48-bit hashes. Two
documents link when ``100 * |A & B| >= 80 * |A | B|``.

How it runs at scale:

1. One pass over the texts packs each block's shingles by hash range. A
   reducer per range finds, for each shingle, in how many *different* sets it
   is (1, 2-3, 4-7, ...) and answers with the shared shingles of each block.
   Shingles that only one set holds never travel further. A shingle that several
   documents of a block hold is asked for once a block; who holds it stays with
   the block, so a shingle of all documents puts a few bytes a block into one range.
2. Equal sets collapse to one class. With the rarest shingles first, a class
   whose own (unshared) shingles fill the prefix can link with nothing and is
   settled without a candidate.
3. Grouped prefix join: classes with the same prefix and size form one group;
   groups meet on prefix shingles. First every group meets only the pivot of
   each posting list (linear in the list), and the links found are closed into
   components. Then the groups, divided by component, meet again: only pairs of
   different components are left, and only those that the size bounds cannot
   refuse. Their members are expanded, and those that the sets' parity sketches
   cannot refuse either are verified. No list is ever paired with itself as a
   whole, and no pair is skipped that could still join two components.

Defined results: null or blank text has an empty set (n_shingles 0) and is
linked with nothing; repeated rows and copies share a class; rows with one
doc_id and different texts are different documents; a null doc_id takes part, but
no component is named by it (of nulls alone: null).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

_U = np.uint64
_KEEP = _U((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of a block: (hash, first index of each document)."""
    h, owner, _, _ = c.words_of(data, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(owner, minlength=n_docs)
    if not len(h):
        return np.zeros(0, _U), np.zeros(n_docs + 1, np.int64)
    rolled = np.zeros(len(h), _U)
    for i in range(width):
        part = np.zeros(len(h), _U)
        part[: max(0, len(h) - i)] = h[i:]
        rolled += c.mix(part ^ _U((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)))
    rolled = c.mix(rolled)
    first = np.concatenate([[0], np.cumsum(count)])
    out, at = [], np.zeros(n_docs + 1, np.int64)
    for d in range(n_docs):
        s, e = first[d], first[d + 1]
        if e == s:
            mine = rolled[:0]
        elif e - s < width:  # the whole sequence is the one shingle
            mine = c.mix(np.array([np.bitwise_xor.reduce(c.mix(h[s:e] + np.arange(1, e - s + 1, dtype=_U)))], _U) + _U(e - s)) & _KEEP
        else:
            mine = np.sort(rolled[s : e - width + 1] & _KEEP)
            mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
        out.append(mine)
        at[d + 1] = at[d] + len(mine)
    return np.concatenate(out), at


def _pack(h: np.ndarray) -> bytes:
    """48 bits each: the high 16 bits of all, then the low 32 bits of all."""
    return (h >> _U(32)).astype("<u2").tobytes() + h.astype("<u4").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return (np.frombuffer(b, "<u2", n).astype(_U) << _U(32)) | np.frombuffer(b, "<u4", n, 2 * n).astype(_U)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in 1, 2 or 4 bytes each, behind a byte that says which."""
    width = 1 if x.max(initial=0) < 1 << 8 else 2 if x.max(initial=0) < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(b: bytes, n: int = -1) -> np.ndarray:
    """What ``_small`` has packed (its first ``n`` numbers)."""
    return np.frombuffer(b, f"<u{b[0]}", n, 1).astype(np.int64)


_REQUEST = pa.schema([("block", pa.string()), ("bucket", pa.int32()), *[(x, pa.binary()) for x in ("shingles", "counts", "sets", "dups", "dup_counts", "dup_sets", "docs", "lists")]])
_REQUEST_DDL = "block string, bucket int, shingles binary, counts binary, sets binary, dups binary, dup_counts binary, dup_sets binary, docs binary, lists binary"


def _requests(bits: int, width: int):
    """Of each block: its shingles by hash range; under a number below 0 its documents, and who holds what several hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, data, offsets in c.text_blocks(batch, "text"):
                h, at = shingle_sets(data, offsets, width)
                owner = np.repeat(np.arange(end - first), np.diff(at))
                digest = np.zeros(end - first, _U)
                np.add.at(digest, owner, c.mix(h + _U(0x1234567)))
                ids = batch.column(0).slice(first, end - first)
                known = np.asarray(ids.is_valid()).astype("<i8")
                docs = np.concatenate([np.asarray(ids.fill_null(0)).astype("<i8"), known, digest.view(np.int64)]).tobytes()
                # What several documents hold: once, with how many they are and the least and the greatest of their sets.
                order = np.argsort(h, kind="stable")
                x, y = h[order], owner[order]
                starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                runs = np.diff(np.append(starts, len(x)))
                many = np.repeat(runs > 1, runs)
                dup = x[starts[runs > 1]]
                dup_n, dup_owner = runs[runs > 1], y[many]
                heads = np.concatenate([[0], np.cumsum(dup_n)])[:-1].astype(np.int64)
                lo, hi = (f.reduceat(digest[dup_owner], heads) if len(dup) else np.zeros(0, _U) for f in (np.minimum, np.maximum))
                lists = len(dup).to_bytes(4, "little") + _small(dup_n) + _small(dup_owner)
                # The others: by range and document.
                alone = np.ones(len(h), bool)
                alone[order[many]] = False
                h, owner = h[alone], owner[alone]
                bucket = (h >> _U(48 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
                order = np.argsort(bucket, kind="stable")
                h, owner = h[order], owner[order]
                cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                dup_cut = np.searchsorted(dup >> _U(48 - bits), np.arange((1 << bits) + 1).astype(_U))
                name = f"{task}-{serial}"
                rows = [(name, -1 - zlib.crc32(name.encode()) % (1 << bits), None, None, None, _pack(dup), None, None, docs, lists)]
                for b in range(1 << bits):
                    s, e, u, v = cut[b], cut[b + 1], dup_cut[b], dup_cut[b + 1]
                    if e > s or v > u:
                        mine = owner[s:e]  # ascending: the sort is stable
                        new = np.flatnonzero(np.diff(mine, prepend=-1))
                        who, n = mine[new], np.diff(np.append(new, len(mine)))
                        rows.append((name, b, _pack(h[s:e]), _small(np.concatenate([who, n])), digest[who].tobytes(), _pack(dup[u:v]), _small(dup_n[u:v]), np.concatenate([lo[u:v], hi[u:v]]).tobytes(), None, None))
                serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _REQUEST, strict=True)], schema=_REQUEST)

    return run


_ANSWER = "block string, bucket int, counts binary, shared binary, shared_counts binary, levels binary, dups binary, dup_levels binary, docs binary, lists binary"


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: which shingles at least two different sets hold, and about how many do. Rows of a block itself are handed on."""
    columns = [x.split()[0] for x in _ANSWER.split(", ")]
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["block", "bucket", "dups", "docs", "lists"]].assign(counts=None, shared=None, shared_counts=None, levels=None, dup_levels=None)[columns]
    tokens, dups = ([_unpack(x) for x in pdf[k]] for k in ("shingles", "dups"))
    whom = [_wide(x).reshape(2, -1) for x in pdf["counts"]]
    held = np.concatenate([np.repeat(np.frombuffer(x, _U), w[1]) for x, w in zip(pdf["sets"], whom, strict=True)])
    least, most = (np.concatenate([held, *[np.frombuffer(x, _U).reshape(2, -1)[k] for x in pdf["dup_sets"]]]) for k in (0, 1))
    times = np.concatenate([np.ones(len(held), np.int64), *[_wide(x) for x in pdf["dup_counts"]]])
    h = np.concatenate([*tokens, *dups])
    level = np.zeros(len(h), np.uint8)
    if len(h):
        order = np.argsort(h)
        x = h[order]
        starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        several = np.minimum.reduceat(least[order], starts) != np.maximum.reduceat(most[order], starts)  # not in copies of one set alone
        total = np.add.reduceat(times[order], starts)
        lg = np.where(several, np.floor(np.log2(np.maximum(total, 2))), 0).astype(np.uint8)
        level[order] = np.repeat(lg, np.diff(np.append(starts, len(x))))
    out, at, dup_at = [], 0, len(held)
    for t, d, w, block, bucket, counts in zip(tokens, dups, whom, pdf["block"], pdf["bucket"], pdf["counts"], strict=True):
        lv, dup_lv = level[at : at + len(t)], level[dup_at : dup_at + len(d)]
        at, dup_at = at + len(t), dup_at + len(d)
        share = lv > 0
        n_share = np.bincount(np.repeat(np.arange(w.shape[1]), w[1])[share], minlength=w.shape[1])
        out.append((block, bucket, counts, _pack(t[share]), _small(n_share), lv[share].tobytes(), None, dup_lv.tobytes(), None, None))
    del tokens, dups, whom, held, least, most, h, level
    c.trim()
    return pd.DataFrame(out, columns=columns)


#: Members of one part of a group.
GROUP = 64
#: Bits of the parity sketch of a set.
SKETCH = 1024
_SETS = "doc_id long, n long, digest long, shared array<long>, sketch array<long>"


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of shingles fall on i. Two sketches differ in at most as many bits as the sets differ in shingles."""
    odd = np.bincount(tokens % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _gathered(num: int, den: int):
    """Per block: size, set digest, and shared shingles (rarest first) of every document that could link."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["bucket"] < 0].iloc[0]
        told = pdf[pdf["bucket"] >= 0].sort_values("bucket")
        ids, known, digest = np.frombuffer(mine["docs"], "<i8").reshape(3, -1)
        n_docs = len(ids)
        n = np.zeros(n_docs, np.int64)
        own, tok, lev = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, np.uint8)]
        for counts, shared, shared_counts, levels in zip(told["counts"], told["shared"], told["shared_counts"], told["levels"], strict=True):
            who, many = _wide(counts).reshape(2, -1)
            n[who] += many
            own.append(np.repeat(who, _wide(shared_counts)))
            tok.append(_unpack(shared))
            lev.append(np.frombuffer(levels, np.uint8))
        several = int.from_bytes(mine["lists"][:4], "little")
        holders = _wide(mine["lists"][4:], several)
        owner = _wide(mine["lists"][5 + several * mine["lists"][4] :])
        n += np.bincount(owner, minlength=n_docs)
        dup_level = np.repeat(np.frombuffer(b"".join(told["dup_levels"]), np.uint8), holders)
        share = dup_level > 0
        own.append(owner[share])
        tok.append(np.repeat(_unpack(mine["dups"]), holders)[share])
        lev.append(dup_level[share])
        own, tok, lev = np.concatenate(own), np.concatenate(tok), np.concatenate(lev)
        n_shared = np.bincount(own, minlength=n_docs)
        # A set with u own shingles overlaps in at most n - u of a union of at least n.
        able = n_shared * den >= n * num
        take = able[own]
        own, tok, lev = own[take], tok[take], lev[take]
        order = np.lexsort((tok, lev, own))
        tok = tok[order].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(np.where(able, n_shared, 0))])
        return pd.DataFrame({"doc_id": pd.Series(ids).where(known.astype(bool)).astype("Int64"), "n": n, "digest": digest, "shared": [tok[at[i] : at[i + 1]] for i in range(n_docs)], "sketch": [_parity(tok[at[i] : at[i + 1]]) if at[i + 1] > at[i] else tok[:0] for i in range(n_docs)]})

    return run


def document_sets(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n, digest, shared): set size and digest, and where a link is possible the shared shingles, rarest first."""
    spark = docs.sparkSession
    c.small_batches(spark)
    bits = max(6, (2 * c.shuffle_partitions(spark) - 1).bit_length())
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_requests(bits, width), _REQUEST_DDL)
    return asked.groupBy("bucket").applyInPandas(_answer, _ANSWER).groupBy("block").applyInPandas(_gathered(num, den), _SETS)


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id); links are ``den * |A & B| >= num * |A | B|``."""
    sets = c.materialize(document_sets(docs, width, num, den).withColumn("row", F.monotonically_increasing_id()), "sets")
    # Equal sets are one class, numbered by one of its rows.
    classes = c.materialize(sets.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first")), "classes")
    able = sets.where(F.size("shared") > 0).join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    need = F.ceil(F.lit(num) * F.col("n") / F.lit(den))
    able = able.select(F.col("row").alias("rep"), "n", "shared", "sketch", (F.col("n") - F.size("shared")).alias("own"))
    # Own shingles come first in the order; what is left of the prefix are shared ones.
    able = able.withColumn("prefix", F.slice("shared", 1, F.greatest(F.lit(0), F.col("n") - need + 1 - F.col("own")).cast("int")))
    able = c.materialize(able.withColumn("grp", F.xxhash64("prefix", "n")), "able")
    groups = able.groupBy("grp", "n").agg(F.min(F.struct("own", "rep", "prefix")).alias("m")).select("grp", "n", F.col("m.own").alias("own"), F.col("m.rep").alias("lead"), F.col("m.prefix").alias("prefix"))
    postings = c.materialize(groups.select(F.explode("prefix").alias("shingle"), "grp", "n", "own", "lead"), "postings")
    members = able.select("grp", "rep", "n", "own")

    # First round: within a group, and on each posting list, all meet the one with the fewest own shingles.
    inside = members.join(groups.select("grp", "lead"), "grp").select(F.col("lead").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("ok"))
    pivots = postings.groupBy("shingle").agg(F.min(F.struct("own", "lead", "n")).alias("p"), F.count("*").alias("many")).where("many > 1").select("shingle", F.col("p.lead").alias("a"), F.col("p.own").alias("a_own"), F.col("p.n").alias("a_n"))
    met = postings.join(pivots, "shingle").where("lead <> a").where(_possible(F.struct(F.col("a_n").alias("n"), F.col("a_own").alias("own")), F.struct("n", "own"), num, den)).select("a", "grp").distinct()
    across = met.join(members, "grp").select("a", F.col("rep").alias("b"))
    links = c.materialize(_verified(inside.select("a", "b").unionAll(across).where("a <> b").distinct(), able, num, den), "links-1")
    labels = c.connected(links, "near-1")

    # Second round: only groups and postings that still hold different components, and only possible partners in them.
    placed = able.select("grp", "rep", "n", "own", "prefix").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # A group's members go with it, in parts of bounded size.
    parts = placed.groupBy("grp", "n", "label").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    placed = placed.join(able.select("rep", "sketch"), "rep").join(parts, ["grp", "n", "label"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    within = placed.groupBy("grp", "n", "label", "part").agg(F.min("own").alias("own"), F.first("prefix").alias("prefix"), F.collect_list(F.struct("rep", "n", "own", "sketch")).alias("members"))
    within = c.materialize(within.withColumn("gid", F.monotonically_increasing_id()), "groups")
    spread = within.select(F.explode("prefix").alias("shingle"), "gid", "n", "own", "label")
    best = spread.groupBy("shingle", "label").agg(F.min("own").alias("low"), F.count("*").alias("members"))
    per = best.groupBy("shingle").agg(F.count("*").alias("many"), F.min(F.struct("low", "label")).alias("first"), F.max(F.struct("members", "label")).alias("big")).where("many > 1")
    others = best.join(per.select("shingle", F.col("first.label").alias("l1"), F.col("first.low").alias("low1"), F.col("big.label").alias("big")), "shingle")
    second = others.where("label <> l1").groupBy("shingle", "l1", "low1", "big").agg(F.min("low").alias("low2"))
    # A partner in another component has at least ``least`` own shingles: overlap <= n - own, union >= n + least.
    open_ = spread.join(second, "shingle").withColumn("least", F.when(F.col("label") == F.col("l1"), F.col("low2")).otherwise(F.col("low1")))
    open_ = open_.where(F.lit(den) * (F.col("n") - F.col("own")) >= F.lit(num) * (F.col("n") + F.col("least")))
    # Of two components one is not the shingle's largest, so one side of the join leaves that out.
    open_ = open_.select("shingle", "gid", "n", "own", "label", (F.col("label") == F.col("big")).alias("big"))
    rows = c.materialize(open_.join(within.select("gid", "members"), "gid"), "open")
    x, y = rows.where("not big").alias("x"), rows.alias("y")
    sizes = [F.struct(F.col(f"{t}.n").alias("n"), F.col(f"{t}.own").alias("own")) for t in "xy"]
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("y.big") | (F.col("x.label") < F.col("y.label"))) & _possible(*sizes, num, den)
    # Groups are expanded where they meet: pairs of members that sizes and sketches cannot refuse.
    able_to = lambda a, b: _possible(a, b, num, den) & _near(a, b, num, den)
    met = met & F.exists("x.members", lambda a: F.exists("y.members", lambda b: able_to(a, b)))
    near = F.flatten(F.transform("x.members", lambda a: F.transform(F.filter("y.members", lambda b: able_to(a, b)), lambda b: F.struct(a["rep"].alias("a"), b["rep"].alias("b")))))
    rest = x.join(y, met).select(F.explode(near).alias("pair")).select("pair.a", "pair.b").distinct()
    more = c.materialize(_verified(rest, able, num, den), "links-2")
    if not more.isEmpty():
        labels = c.connected(links.unionAll(more), "near-2")

    # A table, so that the last join's hot classes (many copies) can be split.
    of_class = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", "n", "first", F.coalesce("label", "rep").alias("label"))
    named = of_class.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = c.materialize(of_class.join(named, "label").select("digest", "n", "component_id"), "of-class")
    return sets.select("doc_id", "n", "digest").join(of_class, ["digest", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _possible(x: Column, y: Column, num: int, den: int) -> Column:
    """Own shingles are not in the other set: overlap <= min(n - own, m - other), union >= max(n + other, m + own)."""
    n, own, m, other = x["n"], x["own"], y["n"], y["own"]
    return F.lit(den) * F.least(n - own, m - other) >= F.lit(num) * F.greatest(n + other, m + own)


def _near(x: Column, y: Column, num: int, den: int) -> Column:
    """The sets x and y differ in their own shingles and at least in the bits in which their sketches differ."""
    bits = F.aggregate(F.zip_with(x["sketch"], y["sketch"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    return (x["own"] + y["own"] + bits) * F.lit(den + num) <= F.lit(den - num) * (x["n"] + y["n"])


def _verified(pairs: DataFrame, able: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold; what two sets share is in their shared shingles."""
    left = able.select(F.col("rep").alias("a"), F.col("n").alias("a_n"), F.col("shared").alias("a_shared"))
    right = able.select(F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("shared").alias("b_shared"))
    both = pairs.join(left, "a").join(right, "b")
    same = F.size(F.array_intersect("a_shared", "b_shared"))
    return both.withColumn("same", same).where(F.lit(den) * F.col("same") >= F.lit(num) * (F.col("a_n") + F.col("b_n") - F.col("same"))).select("a", "b")


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(c.table(spark, sf_dir, "documents"))


#: The same components in DuckDB: all pairs that share a shingle, then reachability.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT r.node AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""
