"""Concept hierarchies: closures, contexts, attributes, coherence, scope expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .pairs import first_by
from .reachability import Reachability


def descendants(edges: DataFrame, roots: DataFrame, inclusive: bool = True, most: int = 64) -> DataFrame:
    """(root, node) below each root of edges(child, parent): semi-naive, one join of the new nodes a round.

    A hierarchy of more than ``most`` levels is an error.
    """
    down = edges.select(F.col("parent").alias("p"), F.col("child").alias("c")).distinct()
    seen = checkpointed(roots.select(F.col("node").alias("root"), F.col("node").alias("node")).distinct(), "closure")
    frontier = seen
    for _ in range(most):
        new = frontier.join(down, frontier["node"] == F.col("p")).select("root", F.col("c").alias("node")).distinct()
        new = checkpointed(new.join(seen, ["root", "node"], "left_anti"), "closure")
        if new.isEmpty():
            break
        seen, frontier = checkpointed(seen.unionAll(new), "closure"), new
    else:
        raise RuntimeError(f"the hierarchy is deeper than {most} levels")
    return seen if inclusive else seen.where("root <> node")


def ancestor_closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor) of every node, strict: path doubling, so the rounds are the logarithm of the depth."""
    base = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor").distinct()
    known = checkpointed(base, "closure")
    n = known.count()
    for _ in range(most):
        longer = known.alias("x").join(known.alias("y"), F.col("x.ancestor") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.ancestor").alias("ancestor"))
        known = checkpointed(known.unionAll(longer).where("node <> ancestor").distinct(), "closure")
        now = known.count()
        if now == n:
            break
        n = now
    else:
        raise RuntimeError("the closure did not settle")
    return known


def parents(edges: DataFrame, most: int = 10, kind: str | None = None) -> DataFrame:
    """(node, parents): up to ``most`` parents in order."""
    e = edges.where(F.col("type_id") == kind) if kind is not None else edges
    return e.groupBy(F.col("child").alias("node")).agg(F.slice(F.array_sort(F.collect_set("parent")), 1, most).alias("parents"))


def attribute_targets(edges: DataFrame, names: DataFrame, types: dict[str, str]) -> DataFrame:
    """One column of target names per attribute type of edges(src, dst, type_id, pos): the first of each."""
    kinds = F.coalesce(*[F.when(F.col("type_id") == t, F.lit(n)) for t, n in types.items()])
    e = edges.where(F.col("type_id").isin(*types)).select("src", "dst", "pos", kinds.alias("attribute"))
    first = e.groupBy("src", "attribute").agg(F.min_by("dst", F.struct("pos", "dst")).alias("dst"))
    named = first.join(names.select(F.col("node").alias("dst"), "fsn"), "dst", "left")
    return named.groupBy("src").pivot("attribute", list(types.values())).agg(F.first("fsn"))


def concept_context(nodes: DataFrame, edges: DataFrame, is_a: str, attributes: dict[str, str]) -> DataFrame:
    """(sctid, fsn, synonyms, parents, related) of nodes(sctid, fsn, synonyms)."""
    names = nodes.select(F.col("sctid").alias("dst"), F.col("fsn").alias("dst_name"))
    e = edges.join(names, "dst")
    up = e.where(F.col("type_id") == is_a).groupBy(F.col("src").alias("sctid")).agg(F.array_sort(F.collect_set("dst_name")).alias("parents"))
    label = F.coalesce(*[F.when(F.col("type_id") == t, F.lit(n)) for t, n in attributes.items()])
    side = e.where(F.col("type_id").isin(*attributes)).groupBy(F.col("src").alias("sctid")).agg(F.array_sort(F.collect_set(F.concat(label, F.lit(": "), "dst_name"))).alias("related"))
    return nodes.join(up, "sctid", "left").join(side, "sctid", "left")


def coherence(candidates: DataFrame, closure: DataFrame) -> DataFrame:
    """Coherence of each query's candidates(query_id, rank, node) in the hierarchy.

    Mean pairwise Jaccard of ancestor sets (self included), share of candidates on the
    line of the first, and the greatest depth of a common ancestor. Fewer than two
    candidates: 1, 1 and 0.
    """
    selfed = candidates.select(F.col("node")).distinct().select("node", F.col("node").alias("ancestor"))
    near = closure.join(candidates.select("node").distinct(), "node", "left_semi")
    anc = near.unionAll(selfed).groupBy("node").agg(F.collect_set("ancestor").alias("anc"))
    depth = closure.groupBy(F.col("node").alias("ancestor")).agg((F.count("*") + 1).alias("depth"))
    with_anc = candidates.join(anc, "node")
    lists = with_anc.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "anc"))).alias("c"))
    pair = with_anc.alias("x").join(with_anc.alias("y"), (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.rank") < F.col("y.rank")))
    jac = F.size(F.array_intersect("x.anc", "y.anc")) / F.size(F.array_union("x.anc", "y.anc"))
    pairs = pair.groupBy(F.col("x.query_id").alias("query_id")).agg(F.avg(jac).alias("jaccard"))
    common = lists.where(F.size("c") > 1).select("query_id", F.explode(F.aggregate(F.expr("slice(c, 2, size(c))"), F.col("c")[0]["anc"], lambda a, x: F.array_intersect(a, x["anc"]))).alias("ancestor"))
    deep = common.join(depth, "ancestor", "left").groupBy("query_id").agg(F.max(F.coalesce("depth", F.lit(1))).alias("common_depth"))
    first = F.col("c")[0]
    on_line = F.size(F.filter("c", lambda x: F.array_contains(first["anc"], x["node"]) | F.array_contains(x["anc"], first["node"]))) / F.size("c")
    out = lists.join(pairs, "query_id", "left").join(deep, "query_id", "left")
    few = F.size("c") < 2
    return out.select("query_id", F.size("c").alias("n"), F.round(F.when(few, 1.0).otherwise(F.col("jaccard")), 6).alias("jaccard"), F.round(F.when(few, 1.0).otherwise(on_line), 6).alias("lineage"), F.when(few, 0).otherwise(F.coalesce("common_depth", F.lit(0))).cast("long").alias("common_depth"))


def indexed_coherence(candidates: DataFrame, index: Reachability) -> DataFrame:
    """``coherence`` by an index: only what stands above the candidates is looked up, not the closure of the hierarchy."""
    near = checkpointed(index.ancestors(candidates.select("node")), "above")
    higher = index.ancestors(near.select(F.col("ancestor").alias("node")))
    return coherence(candidates, checkpointed(near.union(higher).distinct(), "above"))


def tag_mismatch(matches: DataFrame, source_tags: DataFrame) -> DataFrame:
    """Whether the tag of the found concept differs: matches(id, found_tag), source_tags(id, tag); no source counts as a mismatch."""
    both = matches.join(source_tags, "id", "left")
    bad = F.coalesce(F.col("tag"), F.lit("x")) != F.coalesce(F.col("found_tag"), F.lit(""))
    return both.withColumn("mismatch", bad.cast("int"))


_TOKEN = re.compile(r"\s*(<<|<|\(|\)|=|\*|:|,|\|[^|]*\||\w+)")


def _scope_tokens(expression: str) -> list[str]:
    out, at = [], 0
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a scope expression: {expression}")
        if not m[1].startswith("|"):  # names between bars are for readers
            out.append(m[1])
        at = m.end()
    return out


def scope(expression: str, edges: DataFrame | Reachability, attributes: DataFrame | None = None) -> DataFrame:
    """(node) of a scope expression, by edges(child, parent) or by an index.

    ``<<id`` (with descendants), ``<id``, ``id`` and parentheses, joined by OR, AND or
    MINUS from left to right; a refinement ``: attribute = value, ...`` keeps the nodes that
    have each attribute in attributes(src, dst, type_id) with ``*`` or with a value that is
    an expression itself.
    """
    tokens = _scope_tokens(expression)

    def take(wanted: str | None = None) -> str:
        if not tokens or (wanted is not None and tokens[0] != wanted):
            raise ValueError(f"not a scope expression: {expression}")
        return tokens.pop(0)

    def term() -> DataFrame:
        if tokens and tokens[0] == "(":
            take()
            inside = refined()
            take(")")
            return inside
        kind = take() if tokens and tokens[0] in ("<<", "<") else None
        name = take()
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a scope expression: {expression}")
        root = edges.sparkSession.createDataFrame([(name,)], "node string")
        if kind is None:
            return root
        below = edges.descendants(root, kind == "<<") if isinstance(edges, Reachability) else descendants(edges, root, inclusive=kind == "<<")
        return below.select("node")

    def joined() -> DataFrame:
        out = term()
        while tokens and tokens[0] in ("OR", "AND", "MINUS"):
            op, other = take(), term()
            out = out.union(other).distinct() if op == "OR" else out.intersect(other) if op == "AND" else out.subtract(other)
        return out

    def refined() -> DataFrame:
        out = joined()
        if tokens and tokens[0] == ":":
            if attributes is None:
                raise ValueError("a refinement needs attributes")
            take()
            while True:
                kind = take()
                take("=")
                have = attributes.where(F.col("type_id") == kind)
                if tokens and tokens[0] == "*":
                    take()
                else:
                    have = have.join(term().select(F.col("node").alias("dst")), "dst", "left_semi")
                out = out.join(have.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
                if not tokens or tokens[0] != ",":
                    break
                take()
        return out

    out = refined()
    if tokens:
        raise ValueError(f"not a scope expression: {expression}")
    return out


def neighbour_sets(rows: DataFrame, concept: str, attribute: str) -> DataFrame:
    """For each concept the others that share an attribute value: (concept, neighbour)."""
    a = rows.select(F.col(concept).alias("concept"), F.col(attribute).alias("v")).where("v is not null").distinct()
    return a.alias("x").join(a.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.concept") != F.col("y.concept"))).select(F.col("x.concept").alias("concept"), F.col("y.concept").alias("neighbour")).distinct()


def neighbour_counts(rows: DataFrame, concept: str, attribute: str) -> DataFrame:
    """(concept, n): how many others share an attribute value; groups are only counted where concepts have one value each."""
    a = rows.select(F.col(concept).alias("concept"), F.col(attribute).alias("v")).where("v is not null").distinct()
    values = a.groupBy("concept").agg(F.count("*").alias("values"))
    sizes = a.groupBy("v").agg(F.count("*").alias("size"))
    one = a.join(values.where("values = 1").select("concept"), "concept").join(sizes, "v").select("concept", (F.col("size") - 1).alias("n"))
    several = a.join(values.where("values > 1").select("concept"), "concept")
    others = several.join(a.withColumnRenamed("concept", "neighbour"), "v").where("concept <> neighbour").select("concept", "neighbour").distinct()
    return one.where("n > 0").unionByName(others.groupBy("concept").agg(F.count("*").alias("n")))


def first_attribute(columns: Sequence[str]) -> Column:
    """The first non-blank of several columns."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in columns])


def dictionary_lookup(rows: DataFrame, attributes: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """The first attribute, in order, whose key is in dictionary(key, value); keys also match as
    'x structure' and 'structure of x', the first entry of a key wins."""
    variants = F.explode(F.array(F.struct(F.col("key").alias("k"), F.lit(0).alias("o")), F.struct(F.concat("key", F.lit(" structure")).alias("k"), F.lit(1).alias("o")), F.struct(F.concat(F.lit("structure of "), "key").alias("k"), F.lit(2).alias("o"))))
    table = first_by(dictionary.select(F.lower("key").alias("key"), "value").select("value", variants.alias("v")).select("v.k", "v.o", "value"), ["k"], ["o", "value"]).select("k", "value")
    asked = rows.select("id", F.posexplode(F.array(*[F.lower(F.trim(F.col(a))) for a in attributes])).alias("pos", "k")).where("k <> ''")
    hit = asked.join(table, "k").groupBy("id").agg(F.min_by("value", "pos").alias("value"))
    return rows.select("id").join(hit, "id", "left")


def depth_histogram(closure: DataFrame) -> DataFrame:
    return closure.groupBy("node").agg(F.count("*").alias("ancestors")).groupBy("ancestors").agg(F.count("*").alias("n"))


