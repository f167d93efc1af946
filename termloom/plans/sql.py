"""Functions for ``spark.sql``: table functions for what makes several rows of one, scalar ones for texts.

All but the chunks are SQL functions, which the optimizer sees through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..session import ship


def chunked(text: str | None, size: int, overlap: int) -> Iterator[str]:
    """Chunks of whole sentences of up to ``size`` characters; the last sentences, up to ``overlap``, begin the next one."""
    now: list[str] = []
    for sentence in filter(None, re.split(r"(?<=[.!?]) ", re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "").strip())):
        if now and sum(len(x) + 1 for x in now) + len(sentence) > size:
            yield " ".join(now)
            kept: list[str] = []
            for x in reversed(now):
                if sum(len(y) + 1 for y in kept) + len(x) + 1 <= overlap:
                    kept.append(x)
            now = kept[::-1]
        now.append(sentence)
    if now:
        yield " ".join(now)


@udtf(returnType="pos int, chunk string")
class SentenceChunks:
    """``sentence_chunks(text, size, overlap)``: (pos, chunk)."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunked(text, size, overlap))


#: name -> (arguments, returned, body) of the SQL functions.
SQL_FUNCTIONS = {
    "surface_forms": ("fsn STRING, synonyms ARRAY<STRING>", "TABLE(pos INT, text STRING)", "SELECT p.pos, p.col FROM (SELECT posexplode(filter(array_distinct(concat(array(fsn), coalesce(synonyms, array()))), x -> coalesce(x, '') <> ''))) AS p(pos, col)"),
    "semantic_tag": ("term STRING", "STRING", "CASE WHEN endswith(term, ')') AND contains(term, '(') THEN trim(regexp_replace(substring_index(term, '(', -1), '[)]+$', '')) ELSE '' END"),
    "norm_text": ("t STRING", "STRING", "trim(replace(coalesce(t, ''), ' ', ''))"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions in a session; returns their names."""
    ship(spark)
    spark.udtf.register("sentence_chunks", SentenceChunks)
    for name, (arguments, returned, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returned} RETURN {body}")
    return ["sentence_chunks", *SQL_FUNCTIONS]
