"""Operator 2: BPE encoding and decoding, speculate and verify.

For the distinct words of a batch, greedy longest match proposes tokens, array
checks test every adjacent pair, and only words with a clash are merged exactly
(``bpe_core``). Words are cached per worker up to a fixed number, so memory is
bounded however many distinct words there are. The map has no shuffle: it scales
with the number of files.

The vocabulary is read on the driver and sent as one broadcast of the file's
bytes (1.7 MB).

Defined results: null text is the empty text, with 0 tokens; special-token
strings inside texts are special tokens, as the library has it; repeated rows
each get their row; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _common as c
from .bpe_core import Merges, Trie, flat, propose_and_verify

#: Distinct words that a worker remembers.
CACHE_WORDS = 250_000
#: Characters of text whose new words are encoded together.
BLOCK = 1 << 20
#: Words of more symbols than this are merged one by one.
LONG = 64


def _unsure() -> np.ndarray:
    """Characters that Python and the library may class, compose or lower-case differently, as their Unicode data differ.

    These are marks that are reordered (but the common ones), what is not assigned
    here, newer letters, and planes beyond the first but for the ideographs. Texts
    with one are normalised and split by the library.
    """
    out = np.zeros(0x110000, bool)
    for i in range(0x80, 0x10000):
        out[i] = not 0x300 <= i < 0x370 and (unicodedata.combining(chr(i)) > 0 or unicodedata.category(chr(i)) == "Cn")
    for a, b in ((0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x1C89, 0x1C89), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CB, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x10000, 0x1F2FF), (0x1FC00, 0x10FFFF)):
        out[a : b + 1] = True
    return out


_UNSURE = _unsure()


def _is_unsure(text: str) -> bool:
    return bool(_UNSURE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word-end tokens, lower case, from a tokenizer file's bytes."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        self._raw, self._library = raw, None
        vocab, model = spec["model"]["vocab"], spec["model"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern)
        n = max(max(vocab.values()), *self.special.values()) + 1
        self.text = [""] * n
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        when = np.full(n, -1, np.int64)
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i = vocab[a + b]
            left[i], right[i], when[i] = vocab[a], vocab[b], rank
            pairs[vocab[a], vocab[b]] = i
        self.merges = Merges(left, right, when, pairs)
        alphabet = byte_alphabet()
        self._inner = np.array([vocab[x] for x in alphabet], np.int64)
        self._final = np.array([vocab[x + suffix] for x in alphabet], np.int64)
        sequences: dict[int, tuple[int, ...]] = {int(i): (int(i),) for i in [*self._inner, *self._final]}
        for a, b in sorted(pairs, key=lambda p: when[pairs[p]]):
            if a in sequences and b in sequences:
                sequences[pairs[a, b]] = sequences[a] + sequences[b]
        self.trie = Trie({s: t for t, s in sequences.items()}, n)
        self._known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._known.clear()
        self._ids, self._at = np.zeros(1 << 16, np.int64), np.zeros(CACHE_WORDS + 1, np.int64)
        self._shown: list[str] = []
        self.exact_words = 0

    def words(self, text: str) -> list[str]:
        """Words of the normalised text; special tokens stand as themselves."""
        if "<|" in text and self._cut is not None:
            out = []
            for i, part in enumerate(self._cut.split(text)):
                out += [part] if i % 2 else self._plain_words(part)
            return out
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii() and _is_unsure(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self._raw.decode())
            of = {x: b for b, x in enumerate(byte_alphabet())}
            split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
            return [bytes([of[x] for x in w]).decode() for w, _ in split]
        return self._words.findall(self._normal(text))

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # the library lower-cases by character, without the final form of sigma
            text = text.replace("Σ", "σ")
        return text.lower()

    def _learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        if len(self._known) + len(words) > CACHE_WORDS:
            self._reset()
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self._inner[data]
        symbols[at[1:] - 1] = self._final[data[at[1:] - 1]]
        special = np.array([w in self.special for w in words], bool)
        plain = (size <= LONG) & ~special
        if plain.all():
            ids, ids_at, redone = propose_and_verify(symbols, at, self.trie, self.merges)
        else:
            some = symbols[np.repeat(plain, size)]
            part, part_at, redone = propose_and_verify(some, np.concatenate([[0], np.cumsum(size[plain])]), self.trie, self.merges)
            bounds, j, each = part_at, 0, []
            for i, w in enumerate(words):
                if plain[i]:
                    each.append(part[bounds[j] : bounds[j + 1]])
                    j += 1
                else:
                    each.append([self.special[w]] if special[i] else self.merges.exact(symbols[at[i] : at[i + 1]].tolist()))
            ids, ids_at = flat(each)
        self.exact_words += redone
        n = len(self._known)
        base = int(self._at[n])
        if base + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), len(ids)), np.int64)])
        self._ids[base : base + len(ids)] = ids
        self._at[n + 1 : n + len(words) + 1] = base + ids_at[1:]
        text, listed, bounds = self.text, ids.tolist(), ids_at.tolist()
        for i, w in enumerate(words):
            self._known[w] = n + i
            self._shown.append(" ".join([text[t] for t in listed[bounds[i] : bounds[i + 1]]]))

    def _indexed(self, words: list[str]) -> np.ndarray:
        known = self._known
        try:
            return np.array([known[w] for w in words], np.int64)
        except KeyError:
            pass
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        before = len(known)
        if before + len(fresh) > CACHE_WORDS:
            fresh = list(dict.fromkeys(words))
        self._learn(fresh)
        return np.array([known[w] for w in words], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Token ids, and the decoded text of these ids (tokens joined by spaces: the file has no decoder)."""
        return self._of(self.words(text))

    def _of(self, words: list[str]) -> tuple[np.ndarray, str]:
        ids, shown = [], []
        for first in range(0, len(words), CACHE_WORDS // 2):
            part = words[first : first + CACHE_WORDS // 2]
            w = self._indexed(part)
            start, size = self._at[w], self._at[w + 1] - self._at[w]
            ends = np.cumsum(size)
            ids.append(self._ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)])
            texts = self._shown
            shown += [texts[i] for i in w.tolist()]
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), " ".join(shown)

    def decode(self, ids) -> str:
        return " ".join([self.text[i] for i in ids])

    def encode_split(self, split: list[list[str]]) -> Iterator[tuple[np.ndarray, str]]:
        """``encode`` of many texts that are split into words; new words are encoded together."""
        known = self._known
        fresh = dict.fromkeys(w for words in split for w in words if w not in known)
        if len(known) + len(fresh) > CACHE_WORDS:
            fresh = dict.fromkeys(w for words in split for w in words)
        if fresh and len(fresh) <= CACHE_WORDS:
            self._learn(list(fresh))
        for words in split:
            yield self._of(words)


_loaded: dict[str, WordBpe] = {}


def tokenizer_of(raw: bytes) -> WordBpe:
    """The worker's tokenizer for these bytes, built once."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(raw)
    return _loaded[key]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoded(raw, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(raw.value)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            others = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            n, first = batch.num_rows, 0
            while first < n:
                texts, end, size = [], first, 0
                while end < n and (size < BLOCK or end == first):
                    texts.append(col[end].as_py() or "")
                    size += len(texts[-1])
                    end += 1
                counts, digests, shown, lists = [], [], [], []
                split = [tok.words(t) for t in texts]
                for ids, text in tok.encode_split(split):
                    counts.append(len(ids))
                    packed = ids.astype("<u4")
                    digests.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    shown.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        lists.append(packed.astype(np.int32))
                cols = [batch.column(i).slice(first, end - first) for i in others]
                names = [batch.schema.names[i] for i in others] + ["n_tokens", "ids_sha256", "decoded_sha256"]
                cols += [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(shown, pa.string())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
                first = end
            c.trim()

    return run


def encode_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """(*keep, n_tokens, ids_sha256, decoded_sha256[, ids]) of every document's text."""
    spark = docs.sparkSession
    c.small_batches(spark)
    with open(path or default_path(), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    made = StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return rows.mapInArrow(_encoded(raw, with_ids), StructType([*[f for f in rows.schema if f.name != "text"], *made.fields]))


def op2_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encode_documents(c.table(spark, sf_dir, "documents"))
