"""Tables written and read back: lineage cuts, keyed caches, resume, publishing."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of local sessions that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="termloom-shared-")
    return _own[context.applicationId]


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder; later plans read them from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest(*parts: str, size: int = 4) -> str:
    """A short content name."""
    h = hashlib.blake2b(digest_size=size)
    for p in parts:
        h.update(p.encode())
        h.update(b"\0")
    return h.hexdigest()


def content_digest(df: DataFrame, size: int = 4) -> str:
    """A name for the rows of a table, whatever their order: computed in one distributed aggregate."""
    row = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 31))), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("b")).first()
    return digest(str(r["n"]), str(r["a"]), str(r["b"]), ",".join(df.columns), size=size)


def content_groups(df: DataFrame, by: str, size: int = 8) -> DataFrame:
    """(by, name): a short name of each group's rows, whatever their order; groups of equal rows have one name."""
    row = F.xxhash64(*[c for c in df.columns if c != by])
    sums = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("a"), F.bit_xor(row).alias("b"))
    return sums.select(by, F.left(F.md5(F.concat_ws(",", "n", "a", "b").cast("binary")), F.lit(size)).alias("name"))


def resume_by_key(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no output yet; a row with an error counts as done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resume_by_count(todo: DataFrame, done: int, pos: str = "pos") -> DataFrame:
    """Rows after the first ``done``, by sequential position."""
    return todo.where(F.col(pos) > done)


def cached_lookup(wanted: DataFrame, cache: DataFrame | None, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows of the wanted keys, and computed ones for the keys that the cache lacks."""
    if cache is None:
        return compute(wanted)
    have = cache.join(wanted.select(key).distinct(), key, "left_semi")
    return have.unionByName(compute(wanted.join(cache.select(key).distinct(), key, "left_anti")))


def status(expected: int | None, present: int | None) -> str:
    """ready, partial, missing, not_built or no_pairs, from row counts."""
    if expected is None:
        return "not_built"
    if expected == 0:
        return "no_pairs"
    if present is None:
        return "missing"
    return "ready" if present >= expected else "partial"


_NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,62}")


class Registry:
    """Published datasets and guides in one folder of a file system that Spark reaches: immutable versions, with provenance.

    The rows of a version are complete before its entry is put under the next number, and an entry is
    only put where none is: of two writers one wins, and readers see an old version or a new one, never a part.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a name: {name!r}")
        return f"{self.root}/{kind}/{name}"

    def _at(self, path: str):
        """(file system, path) in the JVM."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, kind: str, name: str) -> list[int]:
        """Numbers of the published versions, in order."""
        system, folder = self._at(self._path(kind, name) + "/entries")
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{8}\.json", n))

    def entry(self, kind: str, name: str, version: int | None = None) -> dict | None:
        """The entry of a version, of the latest if none is given; None if there is none."""
        have = self.versions(kind, name)
        if not have or (version is not None and version not in have):
            return None
        system, p = self._at(f"{self._path(kind, name)}/entries/{version or have[-1]:08d}.json")
        stream = system.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put_if_absent(self, path: str, text: str) -> bool:
        """Whether the file was put there; a file that is there already stays as it is."""
        jvm = self.spark.sparkContext._jvm
        system, target = self._at(path)
        _, draft = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if system.getUri().getScheme() == "file":  # a link is made or refused in one step
                to = jvm.java.nio.file.Path.of(system.makeQualified(target).toUri())
                jvm.java.nio.file.Files.createLink(to, jvm.java.nio.file.Path.of(system.makeQualified(draft).toUri()))
                return True
            none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri()).rename(draft, target, options)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            system.delete(draft, False)

    def publish(self, kind: str, name: str, df: DataFrame, provenance: dict | None = None, replace: bool = False) -> dict:
        """Write the rows and put an entry; an entry made by hand is never replaced, nor one that another writer put meanwhile."""
        old = self.entry(kind, name)
        if old is not None and (old.get("origin") != "published" or not replace):
            raise FileExistsError(f"{kind}/{name} is already there")
        version = (self.versions(kind, name) or [0])[-1] + 1
        path = self._path(kind, name)
        rows = f"{path}/rows/{version:08d}-{uuid.uuid4().hex}"
        df.write.parquet(rows)
        made = {"name": name, "kind": kind, "version": version, "origin": "published", "path": rows, "columns": df.columns, "published_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "provenance": provenance or {}}
        if not self._put_if_absent(f"{path}/entries/{version:08d}.json", json.dumps(made, ensure_ascii=False)):
            system, loser = self._at(rows)
            system.delete(loser, True)
            raise FileExistsError(f"{kind}/{name}: another writer put version {version}")
        return made

    def read(self, kind: str, name: str, version: int | None = None) -> DataFrame:
        """The rows of a version, of the latest if none is given."""
        made = self.entry(kind, name, version)
        if made is None:
            raise FileNotFoundError(f"{kind}/{name}")
        return self.spark.read.parquet(made["path"])

    def lineage(self, kind: str, name: str) -> list[str]:
        """The name, its parent, the parent's parent, ..."""
        out, at = [], name
        while at and at not in out:
            e = self.entry(kind, at)
            if e is None:
                break
            out.append(at)
            at = e["provenance"].get("parent")
        return out


def drop_stale(spark: SparkSession, prefix: str, keep: str) -> list[str]:
    """Drop catalog tables of a prefix but the kept one."""
    gone = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefix) and t.name != keep]
    for name in gone:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return gone
