"""Operator 6: license scans by an exact set-similarity join, in DataFrame functions only.

Text blocks are the runs of words, at every place of a text and across line ends,
that are a quarter longer than a template; templates are license sentences; both
are sets of words. A block matches when it contains at least ``threshold`` of the
template's words. Words are put into one global order, rarest in the corpus
first. Of a text that holds a match, its words in that order

* hold one of the first ``n - need + 1`` words of the template (prefix filter),
* are at least ``need`` (length filter), and
* suffice, with what both have before and after the shared word (positional filter).

Only blocks around the template's prefix words in such texts are compared, exactly.

At scale: the frequencies are a partial count of at most one row per template
word; the template side is a constant of the plan, so the join runs within the
scan and no text or block is shuffled, whatever words are hot.

Besides, base phrases are found as consecutive words at their places.

Defined results: null or empty text has 0 words, no labels and score 0; texts
shorter than a block are one block; sentences that are alike give more than one
label (lgpl texts are in the gpl family); repeated rows each get the row's result; A-Z
alone are lower-cased; extra columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# License sentences that the method looks for, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "zlib"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("subject to the terms of the mozilla public license version 2 0", "mpl-2"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("all rights reserved no part of this publication may be reproduced without written permission", "all-rights-reserved"),
)
#: Words of a text: runs of what is no ASCII sign and no control character.
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The signs beyond ASCII whose lower case holds an ASCII letter; any other sign beyond ASCII may stand for them.
_NOT_ASCII = ("\u212a", "\u0130")


def text_words(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased (what other letters become is of no account: no template has any)."""
    for x in _NOT_ASCII:
        text = F.replace(text, F.lit(x), F.lit("\u00b7"))
    return F.array_remove(F.split(F.lower(text), _GAP), "")


def block_length(words: str) -> int:
    """Words in a block that is compared with a template."""
    n = len(words.split())
    return n + n // 4


def _places(w: Column, held: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, from 0."""
    q = phrase.split()
    starts = F.sequence(F.lit(1), F.size(w) - len(q) + 1)

    def here(i: Column) -> Column:
        test = F.lit(True)
        for k, x in enumerate(q):
            test = test & (F.element_at(w, i + k) == x)
        return test

    found = F.transform(F.filter(starts, here), lambda i: i - 1)
    may = (F.size(F.array_intersect(F.lit(sorted(set(q))), held)) == len(set(q))) & (F.size(w) >= len(q))
    return F.when(may, found).otherwise(F.array().cast("array<int>"))


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first, by the number of texts of ``words(w)`` that hold each word."""
    counts = words.select(F.explode(F.array_intersect(F.lit(vocabulary), F.col("w"))).alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # at most one row per word of the vocabulary
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def with_matches(rows: DataFrame, templates, order: list[str], threshold: float) -> DataFrame:
    """``rows(w, held, ...)`` and ``matches``: (template, label, containment, at, length) of every block that meets its template; of blocks of a template that overlap, the best (the first of equal ones)."""
    rank = {w: i for i, w in enumerate(order)}
    library, posted = [], {}
    for i, (sentence, label) in enumerate(templates):
        ranked = sorted(set(sentence.split()), key=rank.get)
        need = max(1, math.ceil(threshold * len(ranked) - 1e-9))
        prefix = ranked[: len(ranked) - need + 1]
        library.append(F.struct(F.lit(label).alias("label"), F.lit(ranked).alias("words"), F.lit(prefix).alias("prefix"), F.lit(need).alias("need"), F.lit(block_length(sentence)).alias("length")))
        for at, w in enumerate(prefix):
            posted.setdefault(w, []).append((i, at, len(ranked), need))
    entry = lambda x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("template", "at", "size", "need"), x, strict=True)])
    index = F.create_map(*[y for w, e in posted.items() for y in (F.lit(w), F.array(*map(entry, e)))])
    held = F.col("held")

    def met(word: Column, pos: Column) -> Column:
        def may(e: Column) -> Column:
            after = F.least(e["size"] - e["at"], F.size(held) - pos)
            return (F.size(held) >= e["need"]) & (F.least(e["at"], pos) + after >= e["need"])

        return F.transform(F.filter(F.coalesce(F.try_element_at(index, word), F.array().cast("array<struct<template:int,at:int,size:int,need:int>>")), may), lambda e: e["template"])

    candidates = F.when(F.arrays_overlap(held, F.lit(sorted(posted))), F.array_distinct(F.flatten(F.transform(held, met)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("candidates", candidates)
    w, books = F.col("w"), F.array(*library)

    def met_blocks(i: Column) -> Column:
        def of(t: Column) -> Column:
            places = F.filter(F.sequence(F.lit(1), F.size(w)), lambda p: F.array_contains(t["prefix"], F.element_at(w, p)))
            starts = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.lit(1), p - t["length"] + 1), p)))))
            blocks = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(t["words"], F.slice(w, s, t["length"]))).alias("same"), s.alias("s")))
            enough = F.filter(blocks, lambda m: m["same"] >= t["need"])

            def apart(kept: Column, m: Column) -> Column:
                last = F.element_at(kept, -1)
                beside = F.when(F.size(kept) == 0, False).otherwise(m["s"] < last["s"] + t["length"])
                better = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(m))
                return F.when(~beside, F.concat(kept, F.array(m))).when(m["same"] > last["same"], better).otherwise(kept)

            best_ones = F.aggregate(enough, F.array().cast("array<struct<same:int,s:int>>"), apart)
            return F.transform(best_ones, lambda m: F.struct(i.alias("template"), t["label"].alias("label"), (m["same"] / F.size(t["words"])).alias("containment"), (m["s"] - 1).alias("at"), F.least(t["length"], F.size(w) - m["s"] + 1).alias("length")))

        # Bound by a lambda, so that the template is looked up once.
        return F.transform(F.array(F.element_at(books, i + 1)), of)[0]

    # Most texts have no candidate: their words are not looked at again.
    found = F.flatten(F.transform(F.filter("candidates", lambda i: F.size(F.array_intersect(F.element_at(books, i + 1)["words"], held)) >= F.element_at(books, i + 1)["need"]), met_blocks))
    return rows.withColumn("matches", F.when(F.size("candidates") > 0, found)).drop("candidates")


def _held(docs: DataFrame, templates, phrases=()) -> tuple[DataFrame, list[str]]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.withColumn("w", text_words(text))
    vocabulary = sorted({x for sentence, _ in [*templates, *phrases] for x in sentence.split()})
    order = word_order(words.select("w"), vocabulary)
    return words.withColumn("held", F.array_intersect(F.lit(order), F.col("w"))), order


def scan_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every block that meets a template in each text of ``docs(key, text)``: (key, template, label, containment, at, length, block)."""
    rows, order = _held(docs.select("key", "text"), templates)
    found = with_matches(rows.select("key", "w", "held"), templates, order, threshold).select("key", "w", F.explode("matches").alias("m"))
    return found.select("key", "m.*", F.array_join(F.slice("w", F.col("m.at") + 1, F.col("m.length")), " ").alias("block"))


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    rows, order = _held(docs.select("doc_id", "text"), templates, base)
    rows = with_matches(rows.select("doc_id", "w", "held"), templates, order, threshold)
    w, held = F.col("w"), F.col("held")
    rows = rows.select("doc_id", F.size(w).cast("long").alias("n_words"), "matches", *[_places(w, held, words).alias(f"base_{i}") for i, (words, _) in enumerate(base)])
    places = [F.col(f"base_{i}") for i in range(len(base))]
    every = F.concat(*places)
    based = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, base, strict=True)]))
    rows = rows.select("doc_id", "n_words", "matches", every.alias("every"), F.array_sort(F.array_distinct(based)).alias("based"))
    both = F.array_sort(F.array_distinct(F.concat("based", F.coalesce(F.col("matches")["label"], F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce(F.array_max(F.col("matches")["containment"]), F.lit(0.0)), F.when(F.size("every") > 0, 1.0).otherwise(0.0))
    return rows.select("doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"), F.array_join("based", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(c.table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same scan in DuckDB: every block of every text against every template, phrases by position."""

    def places(phrase: str) -> str:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {test})"

    gap = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    templates = ", ".join(f"('{label}', string_split('{words}', ' '), {block_length(words)})" for words, label in TEMPLATES)
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(BASE))
    lists = ", ".join(f"{places(words)} AS p{i}" for i, (words, _) in enumerate(BASE))
    every = " || ".join(f"p{i}" for i in range(len(BASE)))
    return f"""
WITH d AS (SELECT doc_id, {low} AS low FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(low, {gap}), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, len(w) AS n_words, {lists} FROM w),
q AS (SELECT doc_id, n_words, {every} AS places, list_distinct(list_filter([{base}], lambda x: x IS NOT NULL)) AS based FROM p),
t AS (SELECT label, list_distinct(words) AS words, ceil(0.8::DOUBLE * len(list_distinct(words)) - 1e-9) AS need, span FROM (VALUES {templates}) AS v(label, words, span)),
c AS (SELECT doc_id, w, label, words, need, span FROM w, t WHERE len(list_intersect(words, w)) >= need),
b AS (SELECT doc_id, label, words, need, list_max(list_transform(range(1, len(w) + 1), lambda i: len(list_intersect(words, w[i:i + span - 1])))) AS same FROM c),
h AS (SELECT doc_id, list(DISTINCT label) AS found, max(same::DOUBLE / len(words)) AS best FROM b WHERE same >= need GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(based), ',') AS base_labels, array_to_string(list_sort(list_distinct(based || coalesce(found, []))), ',') AS labels,
       greatest(coalesce(best, 0), CASE WHEN len(places) > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM q LEFT JOIN h USING (doc_id)"""


SQL = _sql()
