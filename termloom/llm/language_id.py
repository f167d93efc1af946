"""Operator 1: language identification by interpolated Kneser-Ney character models.

Each language has a model of orders 1 to 4 over letters (lower case; everything
else is one space). Probabilities and back-off weights stand in arrays sorted by
the n-gram's hash. A text gets the language of the lowest cross-entropy per
character; it is rejected when that is above a threshold calibrated on training
documents. The prediction depends on the text alone.

The models are fitted on a bounded, documented sample: about ``train_docs``
labelled rows of each language, chosen by a hash of doc_id, so what is collected
and broadcast is bounded too, however large the input. Prediction is one map
without a shuffle.

At most ``most_langs`` languages are learned, those of the most rows: values of a dirty
column that are rare give no model. N-grams are packed in 64 bits, 16 for a letter;
letters beyond the first plane share 4096 codes.

Defined results: null text and text without letters give ``und`` and score 0;
without any labelled training row all texts give ``und``; repeated rows each get
their row; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _common as c

_U = np.uint64
ORDER = 4
UND = "und"
_MASK = [_U((1 << (16 * n)) - 1) for n in range(1, ORDER)] + [_U((1 << 64) - 1)]
_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Letter -> its lower case (16 bits), other characters -> 32."""
    if not _fold:
        out = np.full(0x110000, 32, np.uint16)
        for i in range(0x110000):
            x = chr(i)
            if x.isalpha():
                low = x.lower()
                j = ord(low) if len(low) == 1 else i
                out[i] = j if j < 0x10000 else 0xE000 + (j & 0xFFF)
        _fold.append(out)
    return _fold[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed 4-gram at each character of the folded texts, offsets, letters in each text)."""
    codes = np.frombuffer("".join(["   " + t for t in texts]).encode("utf-32-le"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 3 for t in texts], out=at[1:])
    folded = fold_table()[codes].astype(_U)
    blank = folded == 32
    again = np.zeros(len(codes), bool)  # a space after a space
    again[1:] = blank[1:] & blank[:-1]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    first = np.zeros(len(codes), bool)
    for i in range(3):
        first[at[:-1] + i] = True
    letters = np.bincount(owner[~blank], minlength=len(texts))
    keep = ~again | first
    x, owner, pad = folded[keep], owner[keep], first[keep]
    key = x.copy()
    for i in range(1, ORDER):
        key[i:] |= x[:-i] << _U(16 * i)
    key, owner = key[~pad], owner[~pad]
    return key, np.searchsorted(owner, np.arange(len(texts) + 1)), letters


class CharModel:
    """One language's interpolated Kneser-Ney probabilities, in sorted hash arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, symbols: int) -> None:
        self.hashes, self.logs, self.contexts, self.backs = [], [], [], []
        order_counts = [None] * ORDER
        k, n = keys, counts.astype(np.float64)
        for o in range(ORDER, 0, -1):
            order_counts[o - 1] = (k, n)
            if o > 1:  # continuation counts: how many different characters stand before
                k, n = np.unique(k & _MASK[o - 2], return_counts=True)
                n = n.astype(np.float64)
        lower_key, lower_p = None, None
        for o in range(1, ORDER + 1):
            k, n = order_counts[o - 1]
            n1, n2 = float((n == 1).sum()), float((n == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            d = min(d, 0.95)
            ctx = k >> _U(16)
            cu, inv = np.unique(ctx, return_inverse=True)
            total = np.bincount(inv, weights=n)
            back = d * np.bincount(inv) / total
            if o == 1:
                below = np.full(len(k), 1.0 / (symbols + 1))
                self.unseen = math.log(back[0] / (symbols + 1))
            else:
                below = lower_p[np.searchsorted(lower_key, k & _MASK[o - 2])]
            p = np.maximum(n - d, 0) / total[inv] + back[inv] * below
            order = np.argsort(c.mix(k))
            self.hashes.append(c.mix(k)[order])
            self.logs.append(np.log(p)[order])
            order = np.argsort(c.mix(cu))
            self.contexts.append(c.mix(cu)[order])
            self.backs.append(np.log(back)[order])
            lower_key, lower_p = k, p

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return i, table[i] == h

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of P(last character | three before) for packed 4-grams."""
        out, weight = np.full(len(keys), np.nan), np.zeros(len(keys))
        todo = np.arange(len(keys))
        for o in range(ORDER, 0, -1):
            k = keys[todo] & _MASK[o - 1]
            i, found = self._find(self.hashes[o - 1], c.mix(k))
            out[todo[found]] = weight[todo[found]] + self.logs[o - 1][i[found]]
            todo, k = todo[~found], k[~found]
            if o > 1:
                i, known = self._find(self.contexts[o - 1], c.mix(k >> _U(16)))
                weight[todo[known]] += self.backs[o - 1][i[known]]
        out[todo] = weight[todo] + self.unseen
        return out


class Identifier:
    """All languages' models, and the rejection threshold."""

    _SLOTS = 1 << 17

    def __init__(self, models: dict[str, CharModel], limit: float = float("inf"), middle: float = 0.0) -> None:
        self.langs, self.models = sorted(models), models
        self.limit, self.middle = limit, middle
        self._key: np.ndarray | None = None

    def _memo(self, keys: np.ndarray) -> np.ndarray:
        """Log-probabilities (languages x keys); frequent n-grams are remembered in a table of fixed size."""
        if self._key is None:
            self._key = np.zeros(self._SLOTS, _U)
            self._val = np.zeros((len(self.langs), self._SLOTS), np.float32)
            self._val[:, :] = np.nan
        h = c.mix(keys)
        slot = (h >> _U(47)).astype(np.int64)
        out = self._val[:, slot]
        miss = np.flatnonzero((self._key[slot] != keys) | np.isnan(out[0]))
        if len(miss):
            ask, back = np.unique(keys[miss], return_inverse=True)
            got = np.stack([self.models[x].log_probability(ask) for x in self.langs]).astype(np.float32)
            out[:, miss] = got[:, back]
            slot = (c.mix(ask) >> _U(47)).astype(np.int64)
            self._key[slot] = ask
            won = self._key[slot] == ask
            self._val[:, slot[won]] = got[:, won]
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_key", "_val")} | {"_key": None}

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character: languages x texts, letters in each text)."""
        key, at, letters = grams(texts)
        logs = self._memo(key).astype(np.float64)
        sums = np.concatenate([np.zeros((len(self.langs), 1)), np.cumsum(logs, axis=1)], axis=1)
        size = np.maximum(np.diff(at), 1)
        return -(sums[:, at[1:]] - sums[:, at[:-1]]) / size, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, bool, int]]:
        """(language, score, cross-entropy, rejected, letters) of each text."""
        if not self.langs:
            return [(UND, 0.0, 0.0, True, 0)] * len(texts)
        e, letters = self.entropies(texts)
        best = e.argmin(axis=0)
        low = e.min(axis=0)
        other = np.partition(e, 1, axis=0)[1] if len(self.langs) > 1 else low + 1.0
        score = 1 / (1 + np.exp(-np.minimum((other - low) * np.minimum(letters, 60), 50)))
        strange = (low - self.middle) * np.minimum(1.0, np.sqrt(letters / 200)) > self.limit
        return [(self.langs[b], float(s), float(x), bool(r), int(n)) if n else (UND, 0.0, 0.0, True, 0) for b, s, x, r, n in zip(best, score, low, strange, letters, strict=True)]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for lang in set(langs):
            key, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
            k, n = np.unique(key, return_counts=True)
            mine = total.setdefault(lang, {})
            for a, b in zip(k.view(np.int64).tolist(), n.tolist(), strict=True):
                mine[a] = mine.get(a, 0) + b
    for lang, mine in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine)), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], ["lang", "key", "n"])


def fit(labelled: DataFrame, train_docs: int = 1500, most_langs: int = 512) -> Identifier:
    """Models from ``labelled(doc_id, lang, text)``; about ``train_docs`` rows of each language."""
    spark = labelled.sparkSession
    c.small_batches(spark)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64(F.lit(17), "doc_id").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not sizes:
        return Identifier({})
    shares = spark.createDataFrame([(r["lang"], min(1.0, train_docs / r["count"])) for r in sizes], "lang string, share double")
    rows = rows.join(F.broadcast(shares), "lang")  # at most most_langs rows
    rows = rows.where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < F.col("share")).select("lang", "text")
    table = rows.mapInArrow(_counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(table["lang"].to_pylist(), object)
    keys, counts = np.asarray(table["key"]).view(_U), np.asarray(table["n"])
    symbols = len(np.unique(keys & _MASK[0])) if len(keys) else 1
    models = {}
    for lang in sorted(set(langs.tolist())):
        mine = langs == lang
        order = np.argsort(keys[mine])
        models[lang] = CharModel(keys[mine][order], counts[mine][order], symbols)
    found = Identifier(models)
    if models:
        # Calibration: how far above their middle the training texts themselves lie.
        shared = spark.sparkContext.broadcast(found)
        seen = rows.select(F.lit(0).alias("doc_id"), "text").mapInArrow(_predicted(shared, ()), _COLUMNS).select("lang_pred", "entropy", "letters").where("letters > 0").toPandas()
        if len(seen):
            found.middle = float(seen["entropy"].median())
            t = (seen["entropy"] - found.middle) * np.minimum(1.0, np.sqrt(seen["letters"] / 200))
            found.limit = max(1.5, 3 * float(t.quantile(0.999)))
    return found


_COLUMNS = "lang_pred string, score double, rejected boolean, entropy double, letters long"


def _predicted(shared, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            col, n, first = batch.column(batch.schema.get_field_index("text")), batch.num_rows, 0
            while first < n:
                texts, end, size = [], first, 0
                while end < n and (size < c.BLOCK_BYTES // 2 or end == first):
                    texts.append(col[end].as_py() or "")
                    size += len(texts[-1])
                    end += 1
                found = model.predict(texts)
                lang, score, entropy, rejected, letters = zip(*found, strict=True)
                cols = [batch.column(batch.schema.get_field_index(k)).slice(first, end - first) for k in keep]
                cols += [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64()), pa.array(letters, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *[x.split()[0] for x in _COLUMNS.split(", ")]])
                first = end
            c.trim()

    return run


def identify(docs: DataFrame, model: Identifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score, rejected, entropy, letters) of every document's text."""
    spark = docs.sparkSession
    c.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = StructType([*[rows.schema[k] for k in keep], *StructType.fromDDL(_COLUMNS).fields])
    return rows.mapInArrow(_predicted(shared, keep), schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify(docs, fit(learn))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def kept_languages(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents; the models are fitted on all labelled rows."""
    model = fit(docs)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return identify(rows, model, keep=("row",)).where(~F.col("rejected")).select("row.*")
