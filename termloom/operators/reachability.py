"""A persisted reachability index of a polyhierarchy: intervals instead of the rows of a closure.

A spanning tree (each node under its smallest parent) is numbered in preorder, so what is below a node in
the tree is one interval of numbers. Edges outside the tree hand the intervals of their children to all that is above
them, unless these lie within what a node has anyway. Then ``d`` is below ``a`` if d's number is in an
interval of a. Lookups are equi-joins: an interval is at most two blocks of each power of two, and a number
is in one block of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .order import running

#: Rounds of doubling: hierarchies of up to 2^24 levels; what goes on longer is a cycle.
_ROUNDS = 24
#: Powers of two that blocks are made of: enough for 2^40 nodes.
_POWERS = 40


def _sorted(table: DataFrame) -> DataFrame:
    """For joins of tables that have a row a node: they are small as files, but broadcast they stand whole in the driver's memory."""
    return table.hint("merge")


def _doubled(steps: DataFrame, value: str) -> DataFrame:
    """(node, value) of ``steps(node, up, value)``: the sum of the values from a node up to its root, by pointer doubling."""
    now = checkpointed(steps, "doubling")
    for _ in range(_ROUNDS):
        if now.where("up is not null").isEmpty():
            return now.select("node", value)
        far = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col(value).alias("_value"))
        now = checkpointed(now.join(_sorted(far), "up", "left").select("node", F.col("_up").alias("up"), (F.col(value) + F.coalesce("_value", F.lit(0))).alias(value)), "doubling")
    raise ValueError("the hierarchy has a cycle")


def _preorder(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, start, end) of a forest ``tree(node, up)``: a node's number, and the last one below it."""
    linked = checkpointed(nodes.join(_sorted(tree), "node", "left"), "tree")
    level = checkpointed(_doubled(linked.withColumn("level", F.col("up").isNotNull().cast("long")), "level").join(_sorted(linked), "node"), "levels")
    deepest = level.agg(F.coalesce(F.max("level"), F.lit(0)).alias("n")).first()["n"]
    sizes = below = None
    for at in range(deepest, -1, -1):  # one round a level, each over that level's nodes
        here = level.where(F.col("level") == at)
        if below is not None:
            here = here.join(_sorted(below.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("_below"))), "node", "left")
        size = F.lit(1) + (F.coalesce("_below", F.lit(0)) if below is not None else F.lit(0))
        below = checkpointed(here.select("node", "up", size.cast("long").alias("size")), "sizes")
        sizes = below if sizes is None else sizes.unionAll(below)
    placed = running(sizes, ["node"], "size", by=["up"])
    step = placed.select("node", "up", (F.col("before") + F.col("up").isNotNull().cast("long")).alias("start"))
    return _doubled(step, "start").join(_sorted(sizes.select("node", "size")), "node").select("node", "start", (F.col("start") + F.col("size") - 1).alias("end"))


def _blocks(lo: Column, hi: Column) -> Column:
    """The blocks (power, place) that make up an interval."""
    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.array().cast("array<struct<power:int,place:bigint>>").alias("out"))

    def step(acc: Column, power: Column) -> Column:
        some = acc["lo"] <= acc["hi"]
        left = some & (acc["lo"] % 2 == 1)
        right = some & (acc["hi"] % 2 == 0) & ~(left & (acc["lo"] == acc["hi"]))
        found = F.array_compact(F.array(F.when(left, F.struct(power.alias("power"), acc["lo"].alias("place"))), F.when(right, F.struct(power.alias("power"), acc["hi"].alias("place")))))
        lo, hi = acc["lo"] + left.cast("long"), acc["hi"] - right.cast("long")
        # An emptied interval stays empty at all larger powers.
        return F.struct(F.when(lo <= hi, F.shiftright(lo, 1)).otherwise(1).alias("lo"), F.when(lo <= hi, F.shiftright(hi, 1)).otherwise(0).alias("hi"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_POWERS)), start, step, lambda acc: acc["out"])


def _around(number: Column) -> Column:
    """The block of each power that a number is in."""
    return F.transform(F.sequence(F.lit(0), F.lit(_POWERS)), lambda p: F.struct(p.alias("power"), F.floor(number / F.pow(F.lit(2.0), p)).cast("bigint").alias("place")))


def build_reachability(edges: DataFrame, path: str) -> dict:
    """Write the index of ``edges(child, parent)`` below ``path``; returns the numbers of nodes and intervals. A cycle is an error."""
    e = checkpointed(edges.select("child", "parent").where("child <> parent").distinct(), "edges")
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    tree = checkpointed(e.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up")), "spanning")
    _preorder(nodes, tree).write.parquet(f"{path}/labels")
    spark = edges.sparkSession
    labels = spark.read.parquet(f"{path}/labels")

    own = labels.select("node", "start", "end")
    beyond = lambda rows: rows.join(_sorted(own), "node").where((F.col("lo") < F.col("start")) | (F.col("hi") > F.col("end"))).select("node", "lo", "hi").distinct()
    aside = e.join(_sorted(tree), (e["child"] == tree["node"]) & (e["parent"] != tree["up"]), "left_semi")
    given = aside.join(_sorted(own.withColumnRenamed("node", "child")), "child").select(F.col("parent").alias("node"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    extra = new = checkpointed(beyond(given), "intervals")
    while not new.isEmpty():  # what is known grows with every round, and there are no more intervals than nodes
        up = new.join(_sorted(e), new["node"] == e["child"]).select(e["parent"].alias("node"), "lo", "hi")
        new = checkpointed(beyond(up).join(_sorted(extra), ["node", "lo", "hi"], "left_anti"), "intervals")
        extra = checkpointed(extra.unionAll(new), "intervals")
    if not extra.join(_sorted(own), "node").where("start between lo and hi").isEmpty():
        raise ValueError("the hierarchy has a cycle")
    covers = own.select("node", F.col("start").alias("lo"), F.col("end").alias("hi")).unionAll(extra)
    covers.write.parquet(f"{path}/covers")
    covers.select("node", F.explode(_blocks(F.col("lo"), F.col("hi"))).alias("b")).select("node", "b.*").distinct().write.parquet(f"{path}/blocks")
    covers = spark.read.parquet(f"{path}/covers")
    return {"nodes": labels.count(), "intervals": covers.count()}


class Reachability:
    """An index below a path that any session can open."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.sparkSession = spark
        self.labels, self.covers, self.blocks = (spark.read.parquet(f"{path}/{x}") for x in ("labels", "covers", "blocks"))

    def descendants(self, roots: DataFrame, inclusive: bool = True) -> DataFrame:
        """(root, node) below each of roots(node); a root that the index does not know is alone."""
        asked = roots.select(F.col("node").alias("root")).distinct()
        wanted = _sorted(self.blocks).join(asked, F.col("node") == F.col("root")).select("root", "power", "place")
        numbers = self.labels.select("node", F.explode(_around(F.col("start"))).alias("b")).select("node", "b.*")
        found = numbers.join(_sorted(wanted), ["power", "place"]).select("root", "node").distinct()
        lone = asked.join(_sorted(self.labels.select("node")), F.col("root") == F.col("node"), "left_anti").select("root", F.col("root").alias("node"))
        both = found.unionByName(lone)
        return both if inclusive else both.where("root <> node")

    def ancestors(self, nodes: DataFrame) -> DataFrame:
        """(node, ancestor) above each of nodes(node), strictly."""
        asked = _sorted(self.labels).join(nodes.select("node").distinct(), "node").select("node", F.explode(_around(F.col("start"))).alias("b")).select("node", "b.*")
        above = self.blocks.withColumnRenamed("node", "ancestor")
        return asked.join(_sorted(above), ["power", "place"]).where("node <> ancestor").select("node", "ancestor").distinct()

    def is_below(self, pairs: DataFrame) -> DataFrame:
        """``pairs(above, below)`` with ``holds``: whether the one is an ancestor of the other, or the same."""
        rows = pairs.select("above", "below").distinct()
        number = self.labels.select(F.col("node").alias("below"), "start")
        met = rows.join(_sorted(number), "below").join(_sorted(self.covers.withColumnRenamed("node", "above")), "above").where("start between lo and hi")
        held = met.select("above", "below", F.lit(True).alias("_held")).distinct()
        return pairs.join(held, ["above", "below"], "left").withColumn("holds", F.coalesce("_held", F.col("above") == F.col("below"))).drop("_held")

    def deepest_common(self, pairs: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with ``common``, the common ancestor (or one of the two) that has the most ancestors, of equal ones the smallest; null if none."""
        rows = pairs.select("a", "b").distinct()
        both = rows.select(F.col("a").alias("node")).union(rows.select("b")).distinct()
        up = checkpointed(self.ancestors(both).unionByName(both.withColumn("ancestor", F.col("node"))), "above")
        depth = self.ancestors(up.select(F.col("ancestor").alias("node"))).groupBy(F.col("node").alias("ancestor")).agg(F.count("*").alias("depth"))
        met = rows.join(up.withColumnRenamed("node", "a"), "a").join(up.withColumnRenamed("node", "b"), ["b", "ancestor"]).join(depth, "ancestor", "left")
        best = met.groupBy("a", "b").agg(F.min_by("ancestor", F.struct((-F.coalesce("depth", F.lit(0))).alias("d"), F.col("ancestor"))).alias("common"))
        return pairs.join(best, ["a", "b"], "left")
