"""Operator 12: Merkle manifest of a data set, by postorder traversal of blocks.

Leaves are hashed by Spark where the rows are. Their place in their source comes from a range sort: counts of
its ranges give each an offset. A block is ``16 ** LEVELS`` neighbouring leaves of a source, so its root is a
node of the tree. A recursive traversal returns the digest of each subtree and, as it unwinds,
appends the siblings of a subtree to all leaves that it holds. The roots of the blocks are the nodes of another
traversal of the same kind, and so on; the subroots of the sources are the nodes of the last ones. A proof is what
the block gives and what its root has for a proof, which is joined once a block and not once a leaf.

No task holds more than one block, whatever the sizes of sources, and one column of siblings is as long as
the tree is high.

Defined results: a null source comes first and is a source; a null doc_id comes first in its source and is
never tampered with; equal ids are ordered by their digests (equal rows are interchangeable); an empty
table has no rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

#: Nodes under one.
WIDTH = 16
#: Levels of a block: 4096 leaves.
LEVELS = 3
#: Columns that a leaf holds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: ``-`` for null, else the length in bytes, ``:`` and the value."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def traverse(leaves: list[str], levels: int, full: bool) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, siblings before and after each leaf by level, from the leaf up) of one block.

    A full block is part of a larger tree and has all its levels, others end where one node is left.
    """
    proofs: list[list[tuple[str, str]]] = [[] for _ in leaves]

    def visit(level: int, start: int, end: int) -> str:
        if not level:
            return leaves[start]
        step = WIDTH ** (level - 1)
        children = [(a, min(a + step, end)) for a in range(start, end, step)]
        digests = [visit(level - 1, a, b) for a, b in children]
        for i, (a, b) in enumerate(children):
            beside = ("".join(digests[:i]), "".join(digests[i + 1 :]))
            for leaf in range(a, b):
                proofs[leaf].append(beside)
        return digest_of("".join(digests))

    height = levels
    if not full:
        height = next(h for h in range(levels + 1) if WIDTH**h >= len(leaves))
    return visit(height, 0, len(leaves)), proofs


def fold(leaf: str, proof: list[tuple[str, str]]) -> str:
    """Root that a leaf and its siblings give."""
    for before, after in proof:
        leaf = digest_of(before + leaf + after)
    return leaf


def placed(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes(key, ord, digest, ...)`` with ``at``, the place in its key by (ord, digest), and ``total``, the key's nodes."""
    ranged = nodes.repartitionByRange(c.shuffle_partitions(nodes.sparkSession), "key", "ord", "digest").withColumn("part", F.spark_partition_id())
    ranged = c.materialize(ranged, f"{name}-ranges")
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("n"))
    key = Window.partitionBy("key")
    before = key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(key).alias("total"))
    counts = c.materialize(counts, f"{name}-offsets")
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("ord", "digest"))
    # Dealt by (key, part) for both: a key of any size is many of them.
    return ranged.join(counts.hint("merge"), ["key", "part"]).withColumn("at", F.col("offset") + within - 1).drop("part", "offset")


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / F.lit(block)))


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("at", kind="stable")


def _roots(levels: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        total = int(frame["total"].iloc[0])
        root, _ = traverse(frame["digest"].tolist(), levels, total > WIDTH**levels)
        return pd.DataFrame({"key": frame["key"].iloc[:1], "at": frame["block"].iloc[:1], "digest": [root], "total": [-(-total // WIDTH**levels)]})

    return run


def _proofs(levels: int):
    def run(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        total = int(frame["total"].iloc[0])
        root, proofs = traverse(frame["digest"].tolist(), levels, total > WIDTH**levels)
        upper = [(x["before"], x["after"]) for x in above["proof"].iloc[0]] if len(above) else []
        top = above["top"].iloc[0] if len(above) else root
        return pd.DataFrame(
            {
                "key": frame["key"],
                "at": frame["at"],
                "digest": frame["digest"],
                "top": [top] * len(frame),
                "proof": [[{"before": b, "after": a} for b, a in [*p, *upper]] for p in proofs],
            }
        )

    return run


def proofs_of(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """(key, at, digest, top, proof) of ``nodes(key, at, digest, total)``: top is the root of the key, proof the siblings up to it.

    Meant for roots of blocks and sources, of which there are few: rows carry their siblings.
    """
    block = WIDTH**levels
    nodes = _blocked(nodes, block)
    made = "key string, at long, digest string, top string, proof array<struct<before string, after string>>"
    roots = c.materialize(nodes.groupBy("key", "block").applyInPandas(_roots(levels), "key string, at long, digest string, total long"), f"{name}-roots")
    if roots.where("total > 1").isEmpty():
        above = roots.select("key", F.col("at").alias("block"), F.col("digest").alias("top")).withColumn("proof", F.expr("array()").cast("array<struct<before string, after string>>"))
    else:
        above = proofs_of(roots, levels, f"{name}-up").select("key", F.col("at").alias("block"), "top", "proof")
    return c.materialize(nodes.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInPandas(_proofs(levels), made), f"{name}-proofs")


def _folded(levels: int):
    def run(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        _, proofs = traverse(frame["digest"].tolist(), levels, int(frame["total"].iloc[0]) > WIDTH**levels)
        upper = [(x["before"], x["after"]) for x in above["proof"].iloc[0]]
        rest = "".join(b + a for b, a in upper)
        changed = frame["tampered"].where(frame["tampered"].notna(), frame["digest"])
        return pd.DataFrame(
            {
                "doc_id": frame["id"],
                "leaf": frame["digest"],
                "subroot": above["subroot"].iloc[0],
                "root": above["root"].iloc[0],
                "proof_sha256": [digest_of("".join(b + a for b, a in p) + rest) for p in proofs],
                "folded_root": [fold(leaf, [*p, *upper]) for leaf, p in zip(changed, proofs, strict=True)],
            }
        )

    return run


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``tampered`` is the digest of a changed leaf that is to be held against the manifest (null: as it is).
    """
    c.small_batches(docs.sparkSession)
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))  # null first
    changed = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("ord"), leaf_digest([F.col(k) for k in FIELDS]).alias("digest"), changed.alias("tampered"))
    leaves = c.materialize(placed(c.materialize(leaves, "leaves"), "leaves"), "placed")
    blocks = _blocked(leaves, WIDTH**levels)

    roots = blocks.select("key", "block", "at", "digest", "total").groupBy("key", "block")
    roots = c.materialize(roots.applyInPandas(_roots(levels), "key string, at long, digest string, total long"), "block-roots")
    within = proofs_of(roots, levels, "blocks")  # top: the source's subroot
    sources = within.groupBy("key").agg(F.first("top").alias("digest"))
    sources = placed(sources.select(F.lit("").alias("key"), F.col("key").alias("ord"), "digest"), "sources")
    sources = c.materialize(sources, "placed-sources")
    across = proofs_of(sources.select("key", "at", "digest", "total"), levels, "sources")
    across = across.select("at", F.col("top").alias("root"), F.col("proof").alias("over")).join(sources.select("at", F.col("ord").alias("key")), "at")
    above = within.select("key", F.col("at").alias("block"), F.col("top").alias("subroot"), "proof").join(across.select("key", "root", "over"), "key")
    above = c.materialize(above.select("key", "block", "subroot", "root", F.concat("proof", "over").alias("proof")), "above")

    made = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    blocks = blocks.withColumn("id", F.col("ord").cast("string")).drop("ord")  # pandas has no null among integers
    out = blocks.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInPandas(_folded(levels), made)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    fields = [lowered(F.col(k)) if k == "text" else F.col(k) for k in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_digest(fields))
    return manifest(docs, tampered)


def _sql(levels: int = 6, over: int = 4) -> str:
    """The same manifest in DuckDB, level by level: for up to 16^levels rows a source and 16^over sources."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def digest(text: str) -> str:
        fields = [f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(fields)})"

    def tree(name: str, height: int) -> list[str]:
        out = []
        for k in range(height):
            group = "PARTITION BY key, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}{k + 1} AS (SELECT key, i // 16 AS i, CASE WHEN total > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, (total + 15) // 16 AS total
  FROM {name}{k} GROUP BY key, i // 16, total)""")
            out.append(f"""{name}{k}b AS (SELECT key, i, total, coalesce(string_agg(d, '') OVER ({group} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(d, '') OVER ({group} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})""")
        return out

    def path(name: str, rows: str, tree_: str, height: int, key: str, at: str) -> list[str]:
        out, now = [], rows
        for i in range(height):
            step = f"""{name}{i} AS (SELECT p.* EXCLUDE (cur, proof), CASE WHEN t.total > 1 THEN sha256(t.b || p.cur || t.a) ELSE p.cur END AS cur, p.proof || t.b || t.a AS proof
  FROM {now} p JOIN {tree_}{i}b t ON t.key = {key} AND t.i = {at} // {WIDTH**i})"""
            out.append(step)
            now = f"{name}{i}"
        return out

    parts = [
        f"""rows AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, {digest("text")} AS leaf,
  CASE WHEN xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)),
    4294967295::UBIGINT) % 5 = 0 THEN {digest(f"translate(text, '{letters}', '{letters.lower()}')")} END AS tampered FROM documents)""",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS total FROM rows)",
        "n0 AS (SELECT key, pos AS i, leaf AS d, total FROM leaves)",
        *tree("n", levels),
        f"tops AS (SELECT key AS source_key, d AS subroot, row_number() OVER (ORDER BY key) - 1 AS place FROM n{levels})",
        "s0 AS (SELECT '' AS key, place AS i, subroot AS d, count(*) OVER () AS total FROM tops)",
        *tree("s", over),
        "q AS (SELECT doc_id, leaf, key, pos, subroot, place, coalesce(tampered, leaf) AS cur, '' AS proof FROM leaves JOIN tops ON source_key = key)",
        *path("p", "q", "n", levels, "p.key", "p.pos"),
        *path("r", f"p{levels - 1}", "s", over, "''", "p.place"),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, s.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = s.d AS verified FROM r{over - 1}, s{over} s"


SQL = _sql()
