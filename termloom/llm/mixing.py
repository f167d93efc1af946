"""Operator 5: mixing sources to target weights by weighted fair queueing.

Each document, in a shuffled order of its source, gets the virtual finish time
*(words of its source up to and with it) / (target of its source)*; a source
that is to be read more than once queues again after its last document, up to
``passes`` times. A source sends no document after its target is reached. All (document,
pass) entries are range-sorted by that time and the queue is cut where the total
budget is used up, so no source is off its target by more than one document.

At scale no task sees a whole source: the shuffled order is the order of
md5(doc_id), so its first three hex digits split each source, the hot one too,
into 4096 ranges whose sums give every range its offset; only ranges are sorted.
The global cut is found in the same way, by sums over ranges of virtual time and over
ranges within the range that holds the cut; only the rows of the last one, one of 33
million, are ordered. Offsets are joined by the ranges that the sums are dealt by anyway.

Defined results: null text has size 0; a null source is a source, last in order;
sources without words have target 0 and nothing of them is taken; ties in the
shuffled order (repeated ids) are ordered by size, so reruns agree on every
value; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

#: Ranges of virtual time that the cut is searched in.
SLOTS = 8192


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = 3) -> DataFrame:
    """(key, source_size, target, budget) of ``sizes(key, source_size)``: shares of the budget by
    weight in key order, none above ``passes`` times its source, the excess reshared.

    One row per source; the level is where the capped sources, taken in the order
    in which they reach their caps, leave the others below theirs.
    """
    whole = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("at", F.row_number().over(whole.orderBy("key")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    order = whole.orderBy(F.col("cap") / F.col("weight"), "at")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("budget", F.sum("source_size").over(whole))
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source in that order that stays below its cap sets the level for all after it.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("final", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight"), F.col("cap"))
    return ranked.select("key", "source_size", target.alias("target"), "budget")


def _rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("key"),  # null last
        word_count(F.col("text").cast("string")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("ord"),
        *[F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)],
    ).withColumn("part", F.substring("ord", 1, 3))


def _queued(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    within = Window.partitionBy("key", "part").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # Dealt by (key, part) as the window needs it; offsets grow with the sources, so they are not broadcast.
    return rows.join(offsets.hint("merge"), ["key", "part"]).withColumn("upto", F.col("offset") + F.sum("size").over(within))


def _finish(i: int) -> Column:
    """Virtual finish time in pass i; null once the source has reached its target before the document."""
    words = F.lit(i) * F.col("source_size") + F.col("upto")
    return F.when((F.col("target") > 0) & (words - F.col("size") < F.col("target")), words / F.col("target"))


def _slot(finish: Column) -> Column:
    return F.least(F.floor(finish * F.lit(SLOTS // 2)), F.lit(SLOTS)).cast("int")


def _within(finish: Column, slot: int) -> Column:
    """Range within a slot."""
    return F.least(F.floor((finish * F.lit(SLOTS // 2) - F.lit(slot)) * F.lit(SLOTS)), F.lit(SLOTS)).cast("int")


def _first_over(entries: DataFrame, slot: Column, before: int):
    """(slot, start) of the first range in which the budget runs out, ``before`` being taken already; None if it does not."""
    sums = entries.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    along = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.lit(before) + F.sum("words").over(along)).withColumn("start", F.col("end") - F.col("words"))
    return sums.where(F.col("end") > F.col("budget")).orderBy("slot").select("slot", "start").first()


def _place(finish: Column) -> Column:
    """Where an entry stands in the queue; repeated rows share a place."""
    return F.struct(finish.alias("a"), F.col("key").alias("b"), F.col("ord").alias("c"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("size").alias("e"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, keep_0, ...) of every document."""
    rows = _rows(docs, ())
    parts = c.materialize(rows.groupBy("key", "part").agg(F.sum("size").alias("words")), "parts")
    targets = source_targets(parts.groupBy("key").agg(F.sum("words").alias("source_size")), weights, passes)
    upto = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("key", "part", F.coalesce(F.sum("words").over(upto), F.lit(0).cast("long")).alias("offset")).join(targets, "key")
    offsets = c.materialize(offsets, "offsets")
    queued = c.materialize(_queued(rows, offsets), "queued")

    entries = queued.where("target > 0").withColumn("finish", F.explode(F.array(*map(_finish, range(passes))))).where("finish is not null").select("key", "ord", "doc_id", "size", "budget", "finish")
    cut = _first_over(entries, _slot(F.col("finish")), 0)
    last = inner = None
    if cut is not None:
        inside = entries.where(_slot(F.col("finish")) == cut["slot"])
        inner = _first_over(inside, _within(F.col("finish"), cut["slot"]), cut["start"])
        line = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        inside = inside.where(_within(F.col("finish"), cut["slot"]) == inner["slot"]).withColumn("place", _place(F.col("finish")))
        within = inside.withColumn("total", F.lit(inner["start"]) + F.sum("size").over(line)).where(F.col("total") <= F.col("budget"))
        last = within.orderBy(F.col("place").desc()).select("place").first()

    def taken(finish: Column) -> Column:
        if cut is None:
            return finish.isNotNull()
        here = _slot(finish) == cut["slot"]
        ahead = (_slot(finish) < cut["slot"]) | (here & (_within(finish, cut["slot"]) < inner["slot"]))
        if last is None:
            return ahead
        p = last["place"]
        end = F.struct(F.lit(p["a"]).alias("a"), F.lit(p["b"]).alias("b"), F.lit(p["c"]).alias("c"), F.lit(p["d"]).cast("long").alias("d"), F.lit(p["e"]).cast("long").alias("e"))
        return ahead | (here & (_within(finish, cut["slot"]) == inner["slot"]) & (_place(finish) <= end))

    flags = [F.when(taken(_finish(i)), 1).otherwise(0) for i in range(passes)]
    out = (_queued(_rows(docs, keep), offsets) if keep else queued).withColumn("copies", sum(flags[1:], flags[0]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[f"keep_{i}" for i in range(len(keep))])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = 3) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    out = mix_sources(docs, weights, passes, keep=tuple(docs.columns)).where("copies > 0")
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"keep_{i}").alias(k) for i, k in enumerate(docs.columns)])


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(c.table(spark, sf_dir, "documents")).drop("copies")


#: The same mix in DuckDB: one exact queue, one exact cut.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos, sum(source_size) OVER () AS budget FROM src),
capped AS (SELECT *, CAST(pos % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM w),
lev AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
fin AS (SELECT arg_min(level, cap / weight) FILTER (WHERE level * weight <= cap) AS final FROM lev),
tgt AS (SELECT source, source_size, CAST(budget AS BIGINT) AS budget, least(coalesce(final, 'inf'::DOUBLE) * weight, cap) AS target FROM lev, fin),
q AS (
  SELECT r.doc_id, r.source, r.ord, r.size, t.source_size, t.target, t.budget,
         CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.ord, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM rows r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT q.*, p, (p * source_size + upto) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS p) WHERE target > 0 AND p * source_size + upto - size < target),
cut AS (
  SELECT doc_id, source, ord, size, budget,
         sum(size) OVER (ORDER BY finish, source NULLS LAST, ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM e),
got AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM cut WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(got.taken, 0) AS taken FROM q LEFT JOIN got USING (doc_id)
"""
