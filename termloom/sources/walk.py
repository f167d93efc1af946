"""Walks over pages that are fetched: retries, and a frontier that a later run takes up.

Each round is a folder of what it fetched. What is still to be fetched follows from the
finished rounds alone, so a walk that was stopped goes on from there, and one that is done does nothing.
All pages are read when a run begins and when it finds no more; a round in between reads the pages of
the round before and, of all others, the addresses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_SCHEMA = "url string, html string, error string, tries int"
_LINK = r'(?i)<a\s[^>]*href="([^"#]+)"'

#: frontier(url, tries) -> (url, html, error); html is null where it failed. One that also passes ``tries`` on saves a join.
Fetch = Callable[[DataFrame], DataFrame]


def fetch_by(get: Callable[[str], str], threads: int = 8) -> Fetch:
    """Fetch with a function of an address, several at a time in each task; what it raises is a failed try."""

    def one(url: str) -> tuple[str | None, str | None]:
        try:
            return get(url), None
        except Exception as e:  # noqa: BLE001  a failed page is a row
            return None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in parts:
                got = list(pool.map(one, pdf["url"]))
                yield pd.DataFrame({"url": pdf["url"], "html": [g[0] for g in got], "error": [g[1] for g in got], "tries": pdf["tries"]})

    def fetch(frontier: DataFrame) -> DataFrame:
        ship(frontier.sparkSession)
        return frontier.select("url", "tries").mapInPandas(run, "url string, html string, error string, tries int")

    return fetch


class Walk:
    """A walk whose state is below a path."""

    def __init__(self, spark: SparkSession, path: str, retries: int = 3) -> None:
        self.spark, self.path, self.retries = spark, path.rstrip("/"), retries

    def _rounds(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = hadoop(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        found = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("round=")]
        return sorted(int(p.getName()[6:]) for p in found if system.exists(hadoop(p, "_SUCCESS")))

    def _read(self, rounds: list[int]) -> DataFrame:
        if not rounds:
            return self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _SCHEMA.split(", "))])
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/round={i}" for i in rounds])

    def _fetched(self) -> DataFrame:
        return self._read(self._rounds())

    def pages(self) -> DataFrame:
        """(url, html, tries) of the pages that were fetched."""
        return self._fetched().where("html is not null").select("url", "html", "tries")

    def failed(self) -> DataFrame:
        """(url, error, tries) of the pages that no try has given so far, with the last error."""
        last = self._fetched().groupBy("url").agg(F.max("html").isNotNull().alias("ok"), F.max_by("error", "tries").alias("error"), F.max("tries").alias("tries"))
        return last.where("not ok").select("url", "error", "tries")

    def _links(self, fetched: DataFrame) -> DataFrame:
        return fetched.where("html is not null").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("url"))

    def _left(self, starts: DataFrame) -> DataFrame:
        """(url, tries) of what is to be fetched, by the starts and the links of all pages."""
        fetched = self._fetched()
        asked = starts.select("url").union(self._links(fetched)).where("url is not null").select("url", F.lit(True).alias("asked"), F.lit(False).alias("ok"), F.lit(0).alias("tries"))
        state = fetched.select("url", F.lit(False).alias("asked"), F.col("html").isNotNull().alias("ok"), "tries")
        rows = asked.unionAll(state).groupBy("url").agg(F.max("asked").alias("asked"), F.max("ok").alias("ok"), F.max("tries").alias("tries"))
        return rows.where(F.col("asked") & ~F.col("ok") & ((F.col("tries") == 0) | (F.col("tries") < self.retries))).select("url", "tries")

    def _next(self, rounds: list[int]) -> DataFrame:
        """(url, tries) of what the last of the rounds leaves: links that no round has asked for, and what failed in it."""
        last = self._read(rounds[-1:])
        row = lambda df, known, ok, tries: df.select("url", F.lit(known).alias("known"), ok.cast("boolean").alias("ok"), tries.cast("int").alias("tries"))
        none = F.lit(None)
        rows = row(self._links(last), False, none, none).unionAll(row(last, True, F.col("html").isNotNull(), F.col("tries"))).unionAll(row(self._read(rounds[:-1]), True, none, none))
        one = rows.groupBy("url").agg(F.max("known").alias("known"), F.max("ok").alias("ok"), F.max("tries").alias("tries"))
        return one.where(~F.col("known") | (~F.col("ok") & (F.col("tries") < self.retries))).select("url", F.coalesce("tries", F.lit(0)).alias("tries"))

    def run(self, starts: DataFrame, fetch: Fetch, most_rounds: int | None = None) -> bool:
        """Fetch starts(url), what they link to, and so on; whether nothing is left to be fetched.

        Pages that failed ``retries`` times are left. Ends when no page is new; ``most_rounds`` stops a run before, to be taken up by another.
        """
        rounds, made, whole = self._rounds(), 0, True
        while True:
            stop = most_rounds is not None and made >= most_rounds
            frontier = self._left(starts) if whole or stop else self._next(rounds)
            if whole or stop:
                if frontier.isEmpty():
                    return True
                if stop:
                    return False
            at = (rounds or [0])[-1] + 1
            got = fetch(frontier)
            if "tries" not in got.columns:
                got = got.join(frontier, "url")
            got.select("url", "html", "error", (F.col("tries") + 1).cast("int").alias("tries")).write.mode("overwrite").parquet(f"{self.path}/round={at}")
            rounds.append(at)
            made += 1
            # A round without answers asked for nothing, or got none for what it asked: all pages tell.
            whole = self._read([at]).isEmpty()
