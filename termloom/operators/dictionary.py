"""Matching texts with a dictionary that is a table: whole phrases, and the longest form inside a text.

A dictionary of a checked size becomes one Aho-Corasick automaton in each worker, which finds all of its entries in
one pass over a text. A larger one is never sent whole: phrases are then joined by
their rarest word, with the words around each place where it stands; forms are
searched in parts of the checked size, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..session import ship

#: Characters of a dictionary that is sent whole; an automaton takes some 30 bytes for each.
SENT_CHARS = 8 << 20


def _size(keys: DataFrame) -> int:
    return keys.agg(F.coalesce(F.sum(F.length("key") + 1), F.lit(0)).alias("n")).first()["n"]


def _searched(sent, mark: str):
    """(id, key) of each entry that stands in a text, between ``mark``s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k in sent.value:
            automaton.add_word(mark + k + mark, k)
        automaton.make_automaton()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, found = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text and len(automaton):
                    hits = {k for _, k in automaton.iter(mark + text + mark)}
                    rows += [i] * len(hits)
                    found += sorted(hits)
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(found, pa.string())], ["id", "key"])
                    rows, found = [], []
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["id", "key"])

    return run


def _by_automaton(texts: DataFrame, keys: DataFrame, mark: str) -> DataFrame:
    spark = texts.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(sorted(r["key"] for r in keys.collect()))  # at most SENT_CHARS
    return texts.select("id", "text").mapInArrow(_searched(sent, mark), StructType([texts.schema["id"], StructField("key", StringType())]))


def _by_rarest_word(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, key): places of each key's rarest word, with as many words around it as the longest key has."""
    words = keys.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    longest = keys.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(1)).alias("n")).first()["n"]
    split = texts.select("id", F.split("text", " ").alias("words"))
    holds = split.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rarity = words.select("word").distinct().join(holds, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = words.join(rarity, "word").groupBy("key").agg(F.min(F.struct("n", "word")).alias("r")).where("r.n > 0").select("key", F.col("r.word").alias("word"))
    around = F.slice("words", F.greatest(F.col("at") + 2 - longest, F.lit(1)), F.lit(2 * longest - 1))
    places = split.select("id", "words", F.posexplode("words").alias("at", "word")).select("id", "word", F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" ")).alias("around"))
    wanted = places.join(rarest.select("word").distinct(), "word", "left_semi")
    return wanted.join(rarest, "word").where(F.col("around").contains(F.concat(F.lit(" "), "key", F.lit(" ")))).select("id", "key").distinct()


def phrase_hits(texts: DataFrame, dictionary: DataFrame, least: int = 4, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(id, key): normalised keys of dictionary(key) that stand as whole phrases in texts(id, text), each once a text.

    Keys of fewer than ``least`` characters are ignored; null texts have no hits.
    """
    keys = dictionary.select(T.normalize_key(F.col("key")).alias("key")).where(F.length("key") >= least).distinct()
    plain = texts.select("id", T.normalize_key(F.col("text")).alias("text"))
    return _by_automaton(plain, keys, " ") if _size(keys) <= sent_chars else _by_rarest_word(plain, keys)


def best_hits(hits: Column, most: int = 6) -> Column:
    """The first ``most`` of an array of keys, longest first (of equal length the smaller), none inside a kept one."""
    ranked = F.array_sort(F.transform(hits, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))

    def step(kept: Column, x: Column) -> Column:
        full = F.size(kept) >= most
        return F.when(full | F.exists(kept, lambda a: a.contains(x["k"])), kept).otherwise(F.concat(kept, F.array(x["k"])))

    return F.aggregate(ranked, F.array().cast("array<string>"), step)


def glossary_matches(texts: DataFrame, dictionary: DataFrame, most: int = 6, least: int = 4, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(id, n_hits, hits) of every text: how many keys it holds, and the best of them."""
    hits = phrase_hits(texts, dictionary, least, sent_chars).groupBy("id").agg(F.collect_list("key").alias("keys"))
    found = hits.select("id", F.size("keys").alias("n_hits"), best_hits(F.col("keys"), most).alias("hits"))
    joined = texts.select("id").join(found, "id", "left")
    return joined.select("id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))


def longest_forms(texts: DataFrame, forms: DataFrame, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(id, form) of every text: the longest of forms(form) inside it, of equal length the smaller; null if none."""
    keys = forms.select(F.col("form").alias("key")).where(F.length("key") > 0).distinct()
    parts = max(1, -(-_size(keys) // sent_chars))
    longest = F.min(F.struct((-F.length("key")).alias("n"), F.col("key").alias("k")))["k"].alias("form")
    best = None
    for i in range(parts):
        part = keys if parts == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == i)
        one = _by_automaton(texts, part, "")
        best = one if best is None else best.unionAll(one)
    found = best.groupBy("id").agg(longest)
    return texts.select("id").join(found, "id", "left")
