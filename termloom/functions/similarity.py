"""Similarity of texts and vectors as Column expressions.

``difflib_ratio`` and ``best_chrf`` are Arrow UDFs: what they compute is a procedure
or a multiset count that no built-in expresses well.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def exact_match(candidate: Column, references: Column) -> Column:
    """Whether the normalised candidate equals one of the normalised references (an array)."""
    return F.array_contains(F.transform(references, T.norm_text), T.norm_text(candidate))


def char_ngrams(text: Column, n: int) -> Column:
    """All character n-grams of a text, in order."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda's variable is not inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: sum over distinct items of the lesser count."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def chrf(candidate: Column, reference: Column, order: int = 6, beta: float = 2.0) -> Column:
    """Sentence chrF (0 to 100) after its published definition: white space removed, mean
    precision and recall over the orders in which both sides have n-grams."""

    def of(pair: Column) -> Column:
        hyp, ref = pair["h"], pair["r"]
        precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
        for n in range(1, order + 1):
            both = (F.length(hyp) >= n) & (F.length(ref) >= n)
            grams = F.struct(char_ngrams(hyp, n).alias("a"), char_ngrams(ref, n).alias("b"))
            same = F.when(both, bound(grams, lambda g: _overlap(g["a"], g["b"]))).otherwise(0).cast("double")
            precision = precision + F.when(both, same / (F.length(hyp) - (n - 1))).otherwise(0.0)
            recall = recall + F.when(both, same / (F.length(ref) - (n - 1))).otherwise(0.0)
            used = used + F.when(both, 1).otherwise(0)
        sums = F.struct((precision / F.greatest(used, F.lit(1))).alias("p"), (recall / F.greatest(used, F.lit(1))).alias("r"))
        b = beta * beta
        return bound(sums, lambda x: F.when((x["p"] + x["r"]) > 0, (1 + b) * x["p"] * x["r"] / (b * x["p"] + x["r"]) * 100).otherwise(0.0))

    return bound(F.struct(T.without_space(candidate).alias("h"), T.without_space(reference).alias("r")), of)


def _sentence_chrf(hyp: str, ref: str, order: int = 6, beta: float = 2.0) -> float:
    hyp, ref = "".join(hyp.split()), "".join(ref.split())
    precision = recall = 0.0
    used = min(order, len(hyp), len(ref))
    for n in range(1, used + 1):
        a = Counter(hyp[i : i + n] for i in range(len(hyp) - n + 1))
        b = Counter(ref[i : i + n] for i in range(len(ref) - n + 1))
        same = sum((a & b).values())
        precision += same / (len(hyp) - n + 1)
        recall += same / (len(ref) - n + 1)
    if not precision + recall:
        return 0.0
    p, r = precision / used, recall / used
    return (1 + beta * beta) * p * r / (beta * beta * p + r) * 100


def _best_chrf(candidate: pd.Series, references: pd.Series) -> pd.DataFrame:
    out, known = [], {}  # equal pairs of a batch are scored once
    for c, refs in zip(candidate, references, strict=True):
        best = (0.0, None)
        for i, r in enumerate(refs if refs is not None else ()):
            pair = (c or "", r or "")
            score = known.get(pair)
            if score is None:
                score = known[pair] = _sentence_chrf(*pair)
            if i == 0 or score > best[0]:
                best = (score, r)
        out.append(best)
    return pd.DataFrame(out, columns=["chrf", "reference"])


def best_chrf(candidate: Column, references: Column) -> Column:
    """Struct (chrf, reference) of the best reference; the first of equals.

    An Arrow UDF: counting n-grams in interpreted lambdas takes ten times as long.
    """
    return F.pandas_udf(_best_chrf, "chrf double, reference string")(candidate, references)


def char_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, white space removed."""
    x, y = T.without_space(a), T.without_space(b)
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of characters, spaces removed, lower case."""
    chars = lambda c: F.filter(F.split(T.norm_lower(c), ""), lambda x: x != "")
    return set_jaccard(chars(a), chars(b))


def dot(a: Column, b: Column) -> Column:
    """Dot product, accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + eps) * (F.sqrt(dot(b, b)) + eps))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def poincare_distance(a: Column, b: Column, k: float = 1.0) -> Column:
    """Distance in the Poincare ball of curvature -k."""
    inner = (1 - k * dot(a, a)) * (1 - k * dot(b, b)) + 1e-7
    return F.acosh(F.greatest(1 + 2 * k * squared_distance(a, b) / inner, F.lit(1.0))) / F.sqrt(F.lit(k))


def _difflib(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def difflib_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity 2M/T."""
    return F.pandas_udf(_difflib, "double")(a, b)


def composite(exact: Column, chrf_score: Column, penalty: Column | None = None) -> Column:
    """.5 exact + .5 chrF / 100, less the penalty unless exact; at least 0."""
    base = 0.5 * exact.cast("double") + 0.5 * chrf_score / 100
    if penalty is not None:
        base = F.when(exact.cast("boolean"), base).otherwise(base - penalty)
    return F.greatest(base, F.lit(0.0))


def hybrid_composite(exact: Column, chrf_score: Column, best_cosine: Column) -> Column:
    return 0.5 * chrf_score / 100 + 0.3 * best_cosine + 0.2 * exact.cast("double")
