"""Operator 4: exact token counts at every prefix, by dynamic programming.

The encoding of a prefix ends in exactly one token that can stand beside the
last token of the shorter prefix before it, so its count is that one's plus one
(``bpe_core.prefix_counts``). A text is a sequence of words that no token
crosses: runs of the space mark, then characters up to the next space mark. The
program runs once for each distinct word of a batch and its counts at every prefix
are kept; counts at any place of a text are the words' sums plus one prefix of one
word, so truncation and budget questions need no second encoding
(``longest_prefix``, column ``fitting_chars``).

Words are cached per worker up to a fixed number; the map has no shuffle.

Defined results: null text is empty, with 0 tokens; special strings inside
texts are ordinary text, as in the library; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from .bpe_codec import BLOCK, default_path
from .bpe_core import Merges, Trie, flat, prefix_counts

#: Distinct words that a worker remembers.
CACHE_WORDS = 250_000
#: Longer words (text without spaces) are merged one by one; their prefixes are counted when a budget ends in them.
LONG = 4096
SPACE = "▁"
_PARTS = regex.compile(f"{SPACE}?[^{SPACE}\n]+|{SPACE}+(?={SPACE}[^{SPACE}\n])|{SPACE}+|\n")


class PieceBpe:
    """A sentence-piece BPE model with byte fallback, from a model file's bytes."""

    def __init__(self, raw: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(raw)
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        rank = {p: -model.pieces[i].score for p, i in pieces.items()}
        chars = sorted({x for p in pieces for x in p})
        n = len(model.pieces) + 5
        #: pseudo tokens for characters that fall back to 1-4 bytes
        self.unknown = len(model.pieces)
        self.weight = np.ones(n, np.int64)
        self.weight[self.unknown : self.unknown + 5] = np.arange(5)
        symbol = {x: i for i, x in enumerate(chars)}
        width = len(chars) + 5
        self._base = len(chars)
        self._symbol = symbol
        table = np.full(0x110000, -1, np.int32)
        for x, i in symbol.items():
            if x in pieces:
                table[ord(x)] = i
        code = np.arange(0x110000)
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        self._table = np.where(table >= 0, table, self._base + size).astype(np.int32)
        left, right, when = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs: dict[tuple[int, int], int] = {}
        # Ranks in time; pieces of equal score (runs of the space mark) are not merged here.
        runs = {p for p in pieces if len(p) > 1 and set(p) == {SPACE}}
        for p in pieces:
            if len(p) > 1 and p not in runs:
                when[pieces[p]] = int(rank[p])
                for i in range(1, len(p)):
                    a, b = pieces.get(p[:i]), pieces.get(p[i:])
                    if a is not None and b is not None and p[:i] not in runs:
                        pairs[a, b] = pieces[p]
        self.merges = Merges(left, right, when, pairs)
        for p, i in pieces.items():  # the two parts that a piece is made of when it stands alone
            if len(p) > 1 and p not in runs:
                made = self._last_merge(p, pieces)
                left[i], right[i] = made
        sequences = {tuple(symbol[x] for x in p): i for p, i in pieces.items() if p not in runs}
        for k in range(1, 5):
            sequences[self._base + k,] = self.unknown + k
        self.trie = Trie(sequences, width)
        self._space = pieces[SPACE]
        self._run_pieces = {len(p) for p in runs} | {1}
        self._run_count: dict[int, int] = {}
        #: of each word: its tokens, whether the first is a lone space mark, the count at each prefix
        self._known: dict[str, tuple[int, bool, np.ndarray | None]] = {}
        #: tokens of words with a space before them, and of those at the beginning of a line
        self._after_space: dict[str, int] = {}
        self._in_front: dict[str, int] = {}

    def _last_merge(self, piece: str, pieces: dict[str, int]) -> tuple[int, int]:
        """Parts of the last merge when the piece's characters are merged alone."""
        ids = [pieces[x] for x in piece]
        pairs, when = self.merges.pairs, self.merges.when
        while True:
            best = min((int(when[m]), i, m) for i in range(len(ids) - 1) if (m := pairs.get((ids[i], ids[i + 1]))) is not None)
            if len(ids) == 2:
                return ids[0], ids[1]
            _, i, m = best
            ids[i : i + 2] = [m]

    def run_count(self, k: int) -> int:
        """Tokens of k space marks: the best-scored merge is always the leftmost, so pieces grow from the left."""
        if k not in self._run_count:
            sizes, out = self._run_pieces, [1] * k
            i = 0
            while i + 1 < len(out):
                if out[i] + out[i + 1] in sizes:
                    out[i : i + 2] = [out[i] + out[i + 1]]
                    i = max(0, i - 1)
                else:
                    i += 1
            self._run_count[k] = len(out)
        return self._run_count[k]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=at[1:])
        return self._table[codes].astype(np.int64), at

    def prefixes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count at each symbol's end, offsets, whether the first token is a lone space mark)."""
        s, at = self.symbols(words)
        count, last = prefix_counts(s, at, self.trie, self.merges, self.weight)
        return count, at, self._alone(words, last, at)

    def _alone(self, words: list[str], last: np.ndarray, at: np.ndarray) -> np.ndarray:
        # Follow the last tokens back from the end of each word that begins with a space mark.
        n = len(words)
        here = at[1:] - 1
        begin = at[:-1]
        sizes = self._lengths
        first = np.full(n, -1, np.int64)
        live = np.arange(n)
        while len(live):
            t = last[here[live]]
            prev = here[live] - sizes[t]
            done = prev < begin[live]
            first[live[done]] = t[done]
            here[live] = prev
            live = live[~done]
        return first == self._space

    @property
    def _lengths(self) -> np.ndarray:
        if not hasattr(self, "_len"):
            out = np.ones(len(self.weight), np.int64)

            def walk() -> None:
                stack = [(0, 0)]
                by: dict[int, list[int]] = {}
                for key, to in zip(self.trie._keys.tolist(), self.trie._to.tolist(), strict=True):
                    by.setdefault(key // self.trie.width, []).append(to)
                while stack:
                    node, depth = stack.pop()
                    if self.trie.token[node] >= 0:
                        out[self.trie.token[node]] = depth
                    stack += [(x, depth + 1) for x in by.get(node, ())]

            walk()
            self._len = out
        return self._len

    def split(self, text: str) -> list[str]:
        """Words of a text: the library puts a space mark in front of any text."""
        return _PARTS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: list[str]) -> None:
        words = [w for w in words if w not in self._known and (w[0] != SPACE or w.strip(SPACE))]
        for w in words:
            if len(w) > LONG:
                ids = self.merges.exact(self.trie.token[self.trie.first(self.symbols([w])[0])].tolist())
                self._known[w] = int(self.weight[ids].sum()), ids[0] == self._space, None
        words = [w for w in words if len(w) <= LONG]
        for first in range(0, len(words), 50_000):
            part = words[first : first + 50_000]
            count, at, alone = self.prefixes(part)
            totals = count[at[1:] - 1].tolist()
            kept, ends = count.astype(np.int16), at.tolist()  # a word of LONG symbols has no more tokens than this holds
            self._known.update(zip(part, zip(totals, alone.tolist(), (kept[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)), strict=True), strict=True))

    def lines(self, text: str) -> tuple[list[str], list[str], int] | None:
        """(words after a space, words that begin a line, line ends) of a text without runs of spaces; None for others."""
        if not text or SPACE in text:
            return None
        first, *rest = text.split("\n")
        after = first.split(" ")
        front = []
        for line in rest:
            words = line.split(" ")
            if words[0]:
                front.append(words[0])
            after += words[1:]
        return None if "" in after else (after, front, len(rest))

    def learn_lines(self, after: set[str], front: set[str]) -> None:
        for words, table, mark in ((after, self._after_space, SPACE), (front, self._in_front, "")):
            new = [w for w in words if w not in table]
            self.learn([mark + w for w in new])
            table.update((w, self._known[mark + w][0]) for w in new)
        self.learn(["\n"])

    def count_lines(self, after: list[str], front: list[str], ends: int) -> int:
        """Tokens of a text in lines, whose words are known."""
        return sum(map(self._after_space.__getitem__, after)) + sum(map(self._in_front.__getitem__, front)) + ends * self._known["\n"][0]

    def forget(self) -> None:
        self._known.clear()
        self._after_space.clear()
        self._in_front.clear()

    def count_split(self, words: list[str]) -> int:
        """Tokens of a text that is split into words."""
        total, run, known = 0, 0, self._known
        for w in words:
            got = known.get(w)
            if got is None:  # a run of space marks; the word after it has one more
                if run:
                    total += self.run_count(run)
                run = len(w)
                continue
            n, alone, _ = got
            if run:
                total += self.run_count(run + 1) - 1 if alone else self.run_count(run)
                run = 0
            total += n
        return total + (self.run_count(run) if run else 0)

    def count(self, text: str) -> int:
        words = self.split(text)
        self.learn(list(dict.fromkeys(words)))
        return self.count_split(words)

    def every_prefix(self, text: str) -> np.ndarray:
        """Token count of each prefix of the text, by its number of characters (0 first)."""
        words = self.split(text)
        if not words:
            return np.zeros(1, np.int64)
        out, total, run = [], 0, 0
        plain = [w for w in words if w.strip(SPACE)]
        count, at, _ = self.prefixes(plain) if plain else (np.zeros(0, np.int64), np.zeros(1, np.int64), None)
        alone = self._prefix_alone(plain, count, at)
        j = 0
        for w in words:
            if not w.strip(SPACE):
                out.append(np.array([total + self.run_count(run + i + 1) for i in range(len(w))]))
                run = len(w)
                continue
            n, lone = count[at[j] : at[j + 1]], alone[at[j] : at[j + 1]]
            j += 1
            if run:
                extra = np.where(lone, self.run_count(run + 1) - 1, self.run_count(run))
                out.append(total + extra + n)
                total += int(extra[-1] + n[-1])
                run = 0
            else:
                out.append(total + n)
                total += int(n[-1])
        full = np.concatenate(out)
        return np.concatenate([[0], full[1:]])  # the mark in front is no character of the text

    def _prefix_alone(self, words: list[str], count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per symbol: whether the encoding of the word up to it begins with a lone space mark."""
        s, _ = self.symbols(words) if words else (np.zeros(0, np.int64), None)
        _, last = prefix_counts(s, at, self.trie, self.merges, self.weight)
        out = np.zeros(len(s), bool)
        sizes = self._lengths
        for i in range(len(at) - 1):
            for p in range(at[i], at[i + 1]):
                prev = p - sizes[last[p]]
                out[p] = last[p] == self._space if prev < at[i] else out[prev]
        return out

    def longest_prefix(self, words: list[str], budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens, of a text that is split into words."""
        best, at, base, run = 0, 0, 0, 0
        for w in words:
            got = self._known.get(w)
            if got is None:  # a run of space marks
                fits = next((i for i in range(len(w), 0, -1) if base + self.run_count(i) <= budget), 0)
                best = at + fits if fits else best
                at, run = at + len(w), len(w)
                continue
            n, alone, counts = got
            if run:
                n += self.run_count(run + 1) - 1 if alone else self.run_count(run)
            if base + n <= budget:  # the whole word fits
                best = at + len(w)
            else:
                counts = self.prefixes([w])[0] if counts is None else counts.astype(np.int64)
                if run:
                    lone = self._prefix_alone([w], counts, np.array([0, len(w)]))
                    counts = counts + np.where(lone, self.run_count(run + 1) - 1, self.run_count(run))
                fits = np.flatnonzero(base + counts <= budget)
                best = at + int(fits[-1]) + 1 if len(fits) else best
            at, base, run = at + len(w), base + n, 0
            if base >= budget:
                break
        return max(0, best - 1)  # the mark in front is no character of the text

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of the text with at most ``budget`` tokens."""
        words = self.split(text)
        self.learn(list(dict.fromkeys(words)))
        return text[: self.longest_prefix(words, budget)]


_loaded: dict[str, PieceBpe] = {}


def model_of(raw: bytes) -> PieceBpe:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded[key] = PieceBpe(raw)
    return _loaded[key]


def _counted(raw, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(raw.value)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            ids, n, first = batch.column(batch.schema.get_field_index("doc_id")), batch.num_rows, 0
            while first < n:
                texts, end, size = [], first, 0
                while end < n and (size < BLOCK or end == first):
                    texts.append(col[end].as_py() or "")
                    size += len(texts[-1])
                    end += 1
                # Texts without runs of spaces are counted by their lines, others word by word.
                lined = [model.lines(t) for t in texts]
                split = [None if x else model.split(t) for x, t in zip(lined, texts, strict=True)]
                after, front = (set().union(*[x[k] for x in lined if x]) for k in (0, 1))
                words = {w for s in split if s for w in s}
                if len(model._known) + len(words) + len(after) + len(front) > CACHE_WORDS:
                    model.forget()
                model.learn_lines(after, front)
                model.learn(list(words))
                counts = np.array([model.count_lines(*x) if x else model.count_split(s) for x, s in zip(lined, split, strict=True)], np.int64)
                nbytes = [len(t.encode()) for t in texts]
                fitting = [model.longest_prefix(model.split(t), limit) if k > limit else len(t) for t, k in zip(texts, counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(nbytes, pa.int64()), pa.array(counts), pa.array(counts > limit), pa.array(fitting, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])
                first = end

    return run


def count_documents(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting_chars) of every document; fitting_chars is the length of its longest prefix of at most ``limit`` tokens."""
    spark = docs.sparkSession
    c.small_batches(spark)
    with open(path or default_path("piece_bpe_32k.model"), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counted(raw, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_documents(c.table(spark, sf_dir, "documents"))
