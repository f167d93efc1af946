"""Text units that two kinds of tokenizer encode alike wherever they stand.

Byte-level BPE cuts a text in front of a space that stands alone between two
characters that are no white space, and no sentence piece goes across it. So a
text is its units (what lies between such spaces), each distinct unit is encoded
once, and a text's tokens are gathered from arrays.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import regex

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt out the cores

#: Characters of text that are handled at a time (a longer text is handled alone).
BLOCK = 1 << 20
#: Distinct units that a worker remembers.
CACHE_UNITS = 1_000_000
#: Signs that some versions of Unicode have as white space; a cut is a space alone between signs that none has.
_DOUBTFUL = "".join(map(chr, (0x180E, 0x200B, 0xFEFF)))
_SIGN = rf"[^\s\x1c-\x1f{_DOUBTFUL}]"
_ALONE = regex.compile(f"(?<={_SIGN}) (?={_SIGN})")


# The pattern of byte-level BPE: a fixed value.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A unit behind a space whose characters have had their classes from the first versions of Unicode on.
_STABLE = re.compile("[ ][!-~\u00a1-\u024f](?:[\n!-~\u00a1-\u024f]*[!-~\u00a1-\u024f])?").fullmatch
#: Units that are encoded as one text.
_JOINED = 2000


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype) -> None:
        self._data, self.size = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self._data):
            data = np.zeros(max(end, 2 * len(self._data)), self._data.dtype)
            data[: self.size] = self._data[: self.size]
            self._data = data
        self._data[self.size : end] = values
        self.size = end

    @property
    def data(self) -> np.ndarray:
        return self._data[: self.size]


class Ragged:
    """Rows of different lengths; ``take`` puts rows one after the other."""

    def __init__(self, dtype) -> None:
        self.pool, self.start, self.length = Grown(dtype), Grown(np.int64), Grown(np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.start.add(self.pool.size + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.pool.add(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the rows, offsets by row)."""
        lengths = self.length.data[rows]
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        where = np.repeat(self.start.data[rows] - at[:-1], lengths)
        where += np.arange(at[-1])
        return self.pool.data[where], at


class Units:
    """Numbers of units; ``learn`` is given the strings of new ones, in the order of their numbers.

    ``in_front`` says what the first unit of a text has in front of it ("" or " ").
    Number 0 stands for no unit.
    """

    def __init__(self, learn: Callable[[list[str]], None], in_front: str, limit: int = CACHE_UNITS) -> None:
        self._learn, self._front, self._limit = learn, in_front, limit
        self._spaced: dict[str, int] = {}
        self._odd: dict[str, int] = {}
        self._first: dict[str, int] = {}
        self._odd_first: dict[str, int] = {}
        self._next = 1

    def forget_if_full(self, forget: Callable[[], None]) -> None:
        if self._next > self._limit:
            for known in (self._spaced, self._odd, self._first, self._odd_first):
                known.clear()
            self._next = 1
            forget()

    def _numbers(self, known: dict[str, int], names: list[str], before: str, strict: bool) -> np.ndarray:
        """Numbers of the names; if strict, 0 for those that white space stands at an end of."""
        out = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        missing = out < 0
        if missing.any():
            new = list(dict.fromkeys(compress(names, missing.tolist())))
            if strict:
                for u in new:
                    if not u or u[0].isspace() or u[-1].isspace() or u[0] in _DOUBTFUL or u[-1] in _DOUBTFUL:
                        known[u] = 0
                new = [u for u in new if u not in known]
            if new:
                self._learn([before + u for u in new])
                known.update(zip(new, range(self._next, self._next + len(new)), strict=True))
                self._next += len(new)
            out[missing] = np.fromiter(map(known.__getitem__, compress(names, missing.tolist())), np.int64, int(missing.sum()))
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the texts' units, offsets by text)."""
        split = [t.split(" ") if t else [] for t in texts]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in split], out=at[1:])
        flat = [u for x in split for u in x]
        out = self._numbers(self._spaced, flat, " ", True)
        heads = at[:-1][np.diff(at) > 0]
        if self._front != " " and len(heads):
            out[heads] = self._numbers(self._first, [flat[i] for i in heads.tolist()], self._front, True)
        odd = np.unique(np.searchsorted(at, np.flatnonzero(out == 0), "right") - 1)
        if not len(odd):
            return out, at
        cut = {i: _ALONE.split(texts[i]) for i in odd.tolist()}  # runs of white space: cut only where it is safe
        heads = self._numbers(self._odd if self._front == " " else self._odd_first, [x[0] for x in cut.values()], self._front, False)
        rest = self._numbers(self._odd, [u for x in cut.values() for u in x[1:]], " ", False)
        parts, done = [out[at[i] : at[i + 1]] for i in range(len(texts))], 0
        for k, (i, x) in enumerate(cut.items()):
            parts[i] = np.concatenate([heads[k : k + 1], rest[done : done + len(x) - 1]])
            done += len(x) - 1
        at[1:] = np.cumsum([len(p) for p in parts])
        return np.concatenate(parts), at


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer file, for lists of units.

    Units of characters whose classes are the same in all versions of Unicode (below U+0250)
    go to the rank encoder many at a time, where the file's merges stand in the order of their ids; all others, and those
    that may hold a special token, to the library of the file.
    """

    def __init__(self, raw: bytes, special: bool) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw.decode())
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = not special
        alphabet, vocab = byte_alphabet(), self.library.get_vocab()
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in added else bytes(alphabet[x] for x in token)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self._ranks = self._rank_encoder(json.loads(raw), {t: i for t, i in vocab.items() if t not in added})

    def _rank_encoder(self, spec: dict, vocab: dict[str, int]):
        """The rank encoder, if ranks and ids are one order and nothing but the usual pattern cuts the text; else None."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab.get(a + b) for a, b in merges]
        if made != list(range(256, 256 + len(merges))) or spec.get("normalizer") or spec["model"].get("dropout"):
            return None
        if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their numbers by text)."""
        quick = np.array([self._ranks is not None and _STABLE(t) is not None and "<|" not in t for t in texts], bool)
        parts, lengths = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(quick), np.flatnonzero(~quick)])
        some = list(compress(texts, quick.tolist()))
        for first in range(0, len(some), _JOINED):
            part = some[first : first + _JOINED]
            flat = np.array(self._ranks.encode_ordinary("".join(part)), np.uint32)
            ends, wanted = np.cumsum(self.sizes[flat]), np.cumsum([len(t.encode()) for t in part])
            upto = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[upto - 1], wanted):
                raise RuntimeError("a token goes across units")
            parts.append(flat)
            lengths[order[first : first + len(part)]] = np.diff(upto, prepend=0)
        for i, e in zip(order[len(some) :].tolist(), self.library.encode_batch_fast([texts[i] for i in order[len(some) :].tolist()], add_special_tokens=False), strict=True):
            parts.append(np.array(e.ids, np.uint32))
            lengths[i] = len(parts[-1])
        made = Ragged(np.uint32)
        made.add(np.concatenate(parts), lengths[order])
        return made.take(np.argsort(order))[0], lengths


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of a batch; null texts are empty."""
    col, n, first = batch.column(batch.schema.get_field_index(column)), batch.num_rows, 0
    while first < n:
        texts, end, size = [], first, 0
        while end < n and (size < limit or end == first):
            texts.append(col[end].as_py() or "")
            size += len(texts[-1])
            end += 1
        yield first, end, texts
        first = end
