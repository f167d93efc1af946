"""Keyed tables that grow by batches of a stream: caches and index rows that are computed once a key.

Each batch writes a folder named by its number and overwrites only that, so a batch that runs again after a
restart leaves the same table; of several rows of a key the one of the latest batch stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Rows by ``key`` below a path; ``order`` tells the later of two rows of one batch."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str) -> None:
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order

    def _batches(self) -> list[int]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(p):
            return []
        folders = [s.getPath() for s in system.listStatus(p) if s.getPath().getName().startswith("batch=")]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getName()[6:]) for f in folders if system.exists(done(f, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The rows as they stand, of batches before a number if given; None if there are none."""
        have = [b for b in self._batches() if before is None or b < before]
        if not have:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in have])
        names = [c for c in rows.columns if c != "batch"]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch").alias("r"))
        return last.select("r.*")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Put a batch: the last row of each key by ``order``."""
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), self.order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def fill(self, rows: DataFrame, batch: int, compute: Callable[[DataFrame], DataFrame]) -> None:
        """Put the computed rows of the keys that earlier batches lack."""
        have = self.read(before=batch)
        todo = rows.dropDuplicates([self.key])
        if have is not None:
            todo = todo.join(have.select(self.key), self.key, "left_anti")
        compute(todo).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def compact(self) -> None:
        """One folder in place of all, under the number of the last; to be called between runs of the stream."""
        have = self._batches()
        if len(have) > 1:
            draft = f"{self.path}/_compact"
            self.read().write.mode("overwrite").parquet(draft)
            self.spark.read.parquet(draft).write.mode("overwrite").parquet(f"{self.path}/batch={have[-1]}")
            jvm = self.spark.sparkContext._jvm
            for folder in [draft, *[f"{self.path}/batch={b}" for b in have[:-1]]]:
                p = jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run_upserts(stream: DataFrame, table: KeyedTable, checkpoint: str, compute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Run a stream over what is there now into a keyed table; a run after a restart goes on where the last one ended.

    With ``compute`` only keys that the table lacks are computed, else every row of the stream replaces that of its key.
    """

    def put(rows: DataFrame, batch: int) -> None:
        if compute is None:
            table.upsert(rows, batch)
        else:
            table.fill(rows, batch, compute)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()
