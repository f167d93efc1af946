"""Parsers of model replies, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, without_thinking


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def best_index(reply: Column, n: Column) -> Column:
    """1-based choice: the last 'BEST: n', else the last integer; null if outside 1..n."""
    said = without_thinking(F.coalesce(reply, F.lit("")))
    named = _last(F.regexp_extract_all(said, F.lit(r"(?i)BEST\s*:\s*([0-9]{1,9})"), 1))
    any_ = _last(F.regexp_extract_all(said, F.lit(r"([0-9]{1,9})"), 1))
    i = F.coalesce(named, any_).try_cast("int") if hasattr(Column, "try_cast") else F.coalesce(named, any_).cast("int")
    return F.when((i >= 1) & (i <= n), i)


def reason(reply: Column) -> Column:
    """What follows 'REASON:' on its line, else ''."""
    return strip(F.regexp_extract(without_thinking(F.coalesce(reply, F.lit(""))), r"(?i)REASON\s*:\s*([^\n]*)", 1))


def score(reply: Column) -> Column:
    """The last number after 'SCORE:', else the last number of the reply; null if none."""
    said = without_thinking(F.coalesce(reply, F.lit("")))
    named = _last(F.regexp_extract_all(said, F.lit(r"(?i)SCORE\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)"), 1))
    any_ = _last(F.regexp_extract_all(said, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1))
    return F.coalesce(named, any_).cast("double")


def label(reply: Column, labels: Sequence[str]) -> Column:
    """The JSON field 'label', else the first of the labels that stands in the reply, in the given order."""
    said = without_thinking(F.coalesce(reply, F.lit("")))
    field = F.upper(F.regexp_extract(said, r'"label"\s*:\s*"([^"]*)"', 1))
    known = F.when(field.isin(*[x.upper() for x in labels]), field)
    listed = [F.when(F.upper(said).contains(x.upper()), F.lit(x.upper())) for x in labels]
    return F.coalesce(known, *listed)


def confidence(reply: Column, low: int = 1, high: int = 5) -> Column:
    """The JSON field or the word 'confidence', clamped; null if none."""
    found = F.regexp_extract(without_thinking(F.coalesce(reply, F.lit(""))), r'(?i)"?confidence"?\s*[:=]\s*"?([0-9]{1,6})', 1)
    value = F.when(found != "", found.cast("int"))
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def verdict(reply: Column) -> Column:
    """'A', 'B' or 'tie' of a pairwise judgement; null if it cannot be read."""
    said = F.upper(without_thinking(F.coalesce(reply, F.lit(""))))
    found = F.coalesce(_last(F.regexp_extract_all(said, F.lit(r'(?:WINNER|VERDICT)"?\s*:\s*"?(TIE|A|B)\b'), 1)), _last(F.regexp_extract_all(said, F.lit(r"\b(TIE|A|B)\b"), 1)))
    return F.when(found == "TIE", "tie").otherwise(found)


def first_line_bare(reply: Column) -> Column:
    """The first line without quotes and full stop at its ends."""
    line = F.element_at(F.split(strip(without_thinking(F.coalesce(reply, F.lit("")))), "\n"), 1)
    return strip(F.regexp_replace(strip(line), r'^["“”.]+|["“”.]+$', ""))
