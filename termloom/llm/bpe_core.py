"""Byte-pair encoding on arrays: longest-match proposals and pair checks.

Merge ranks order all merges in time. Between two tokens that stand side by
side, BPE merges across the border if a piece on the right edge of the left
token and one on the left edge of the right token are both there at some moment
and their merge comes before either piece is used up by its own token. A
sequence of tokens is the encoding exactly if no neighbours do so.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Later than every merge.
NEVER = np.int64(1) << 40
_SLOTS = 1 << 19


class Merges:
    """Ranked merges over token ids.

    ``left`` and ``right`` give the two parts of each token (-1: a symbol);
    ``when`` is the rank at which a token is made (symbols: -1); ``pairs`` maps
    each mergeable pair of ids to the token made.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, when: np.ndarray, pairs: dict[tuple[int, int], int]) -> None:
        self.left, self.right, self.when, self.pairs = left, right, when, pairs
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        self._keys, self._made = keys[order], made[order]
        self._slot_key = np.full(_SLOTS, -1, np.int64)
        self._slot_ok = np.zeros(_SLOTS, bool)

    def made_by(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token that each pair merges into; -1 if none."""
        key = (a << 32) | b
        i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[i] == key, self._made[i], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b can stand side by side; answers are kept in a table of fixed size."""
        key = (a << 32) | b
        slot = ((key * np.int64(-7046029254386353131)) >> 44) & (_SLOTS - 1)
        out = self._slot_ok[slot]
        miss = np.flatnonzero(self._slot_key[slot] != key)
        if len(miss):
            ask, back = np.unique(key[miss], return_inverse=True)
            ok = self._compatible(ask >> 32, ask & 0xFFFFFFFF)
            out[miss] = ok[back]
            slot = ((ask * np.int64(-7046029254386353131)) >> 44) & (_SLOTS - 1)
            self._slot_key[slot] = ask
            # Several keys may want one slot; what stands there must be the answer to the key that won.
            won = self._slot_key[slot] == ask
            self._slot_ok[slot[won]] = ok[won]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(a)
        ok = np.ones(n, bool)
        at, x, y = np.arange(n), a.copy(), b.copy()
        x_until, y_until = np.full(n, NEVER), np.full(n, NEVER)
        while len(at):
            new = self.made_by(x, y)
            rank = np.where(new >= 0, self.when[new], NEVER)
            clash = (rank < x_until) & (rank <= y_until) & (new >= 0)
            ok[at[clash]] = False
            # Go back in time: undo the later of the two pieces; of the same rank, the left one was made first.
            wx, wy = self.when[x], self.when[y]
            undo_y = wy >= wx
            go = ~clash & (np.maximum(wx, wy) >= 0)
            x_until = np.where(undo_y, x_until, wx)[go]
            y_until = np.where(undo_y, wy, y_until)[go]
            x, y, at = np.where(undo_y, x, self.right[x])[go], np.where(undo_y, self.left[y], y)[go], at[go]
        return ok

    def exact(self, symbols: list[int]) -> list[int]:
        """Merge one sequence: always the earliest rank, the leftmost of equals."""
        n = len(symbols)
        ids, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, when = self.pairs, self.when
        heap = [(int(when[m]), i, ids[i], ids[i + 1], m) for i in range(n - 1) if (m := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (q := pairs.get((m, ids[k]))) is not None:
                    heapq.heappush(heap, (int(when[q]), i, m, ids[k], q))
            h = prv[i]
            if h >= 0 and (q := pairs.get((ids[h], m))) is not None:
                heapq.heappush(heap, (int(when[q]), h, ids[h], m, q))
        return [t for t in ids if t >= 0]


class Trie:
    """Tokens as symbol sequences, walked for many positions at once."""

    def __init__(self, tokens: dict[tuple[int, ...], int], n_symbols: int) -> None:
        self.width = n_symbols
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for seq, t in tokens.items():
            at = 0
            for s in seq:
                to = nodes.get((at, s))
                if to is None:
                    to = nodes[(at, s)] = len(token)
                    token.append(-1)
                at = to
            token[at] = t
        self.token = np.array(token, np.int64)
        self.depth = max(map(len, tokens))
        keys = np.fromiter((a * n_symbols + s for a, s in nodes), np.int64, len(nodes))
        to = np.fromiter(nodes.values(), np.int64, len(nodes))
        order = np.argsort(keys)
        self._keys, self._to = keys[order], to[order]
        first = np.full(n_symbols, -1, np.int64)
        for (a, s), t in nodes.items():
            if a == 0:
                first[s] = t
        self._first = first

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * self.width + symbol
        i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[i] == key) & (symbol >= 0), self._to[i], -1)

    def first(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol >= 0, self._first[symbol], -1)


def flat(sequences: list, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated sequences and their offsets."""
    at = np.zeros(len(sequences) + 1, np.int64)
    np.cumsum([len(s) for s in sequences], out=at[1:])
    out = np.fromiter((x for s in sequences for x in s), dtype, int(at[-1]))
    return out, at


def propose_and_verify(symbols: np.ndarray, at: np.ndarray, trie: Trie, merges: Merges) -> tuple[np.ndarray, np.ndarray, int]:
    """Encode many words (symbols, offsets): (ids, offsets, number of words that needed exact merging).

    Greedy longest match proposes tokens for all words in step; the pair check
    runs over every adjacent pair at once; only words with a clash are merged.
    """
    n = len(at) - 1
    pos, end, word = at[:-1].copy(), at[1:], np.arange(n)
    got_word, got_token = [], []
    live = pos < end
    word, pos, stop = word[live], pos[live], end[live]
    while len(word):
        node, where = trie.first(symbols[pos]), pos + 1
        best, length = trie.token[node], np.ones(len(word), np.int64)
        run = np.flatnonzero(where < stop)
        node = node[run]
        while len(run):
            node = trie.step(node, symbols[where[run]])
            alive = node >= 0
            run, node = run[alive], node[alive]
            where[run] += 1
            t = trie.token[node]
            hit = t >= 0
            best[run[hit]], length[run[hit]] = t[hit], where[run[hit]] - pos[run[hit]]
            more = where[run] < stop[run]
            run, node = run[more], node[more]
        got_word.append(word)
        got_token.append(best)
        pos = pos + length
        live = pos < stop
        word, pos, stop = word[live], pos[live], stop[live]
    if not got_word:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), 0
    owner, ids = np.concatenate(got_word), np.concatenate(got_token)
    order = np.argsort(owner, kind="stable")
    owner, ids = owner[order], ids[order]
    same = np.flatnonzero(owner[1:] == owner[:-1])
    ok = merges.compatible(ids[same], ids[same + 1])
    failing = np.unique(owner[same[~ok]])
    count = np.bincount(owner, minlength=n)
    if len(failing):
        redone = [merges.exact(symbols[at[w] : at[w + 1]].tolist()) for w in failing]
        keep = np.ones(n, bool)
        keep[failing] = False
        new, new_at = flat(redone)
        new_len = np.diff(new_at)
        owner = np.concatenate([owner[keep[owner]], np.repeat(failing, new_len)])
        ids = np.concatenate([ids[keep[np.repeat(np.arange(n), count)]], new])
        order = np.argsort(owner, kind="stable")
        ids = ids[order]
        count[failing] = new_len
    return ids, np.concatenate([[0], np.cumsum(count)]), len(failing)


def prefix_counts(symbols: np.ndarray, at: np.ndarray, trie: Trie, merges: Merges, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token count of every prefix of many words, by dynamic programming.

    The encoding of a prefix is the encoding of a shorter prefix plus one token
    that can stand beside that one's last token; just one such token exists.
    Returns (count, last token) for each symbol's end.
    """
    n = len(at) - 1
    total = len(symbols)
    size = np.diff(at)
    # ends[k]: positions where a token of k + 1 symbols ends, and the token
    node, start = trie.first(symbols), np.arange(total)
    stop = np.repeat(at[1:], size)
    table = np.full((trie.depth, total), -1, np.int32)
    table[0] = trie.token[node]
    live = np.flatnonzero(start + 1 < stop)
    node = node[live]
    for k in range(1, trie.depth):
        node = trie.step(node, symbols[live + k])
        alive = node >= 0
        live, node = live[alive], node[alive]
        if not len(live):
            break
        table[k, live + k] = trie.token[node]
        more = live + k + 1 < stop[live]
        live, node = live[more], node[more]
    count, last = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    longest = int(size.max()) if n else 0
    by_size = np.argsort(-size, kind="stable")
    n_longer = n - np.searchsorted(np.sort(size), np.arange(longest), "right")
    for i in range(longest):
        w = by_size[: n_longer[i]]  # words with a symbol i
        p = at[w] + i
        todo = np.arange(len(p))
        for k in range(min(i, trie.depth - 1), -1, -1):
            t = table[k, p[todo]].astype(np.int64)
            have = np.flatnonzero(t >= 0)
            if not len(have):
                continue
            cand, t = todo[have], t[have]
            here = p[cand]
            if k == i:
                good = np.ones(len(cand), bool)
            else:
                good = merges.compatible(last[here - k - 1], t)
            here, t = here[good], t[good]
            last[here] = t
            count[here] = weight[t] + (0 if k == i else count[here - k - 1])
            done = np.zeros(len(todo), bool)
            done[have[good]] = True
            todo = todo[~done]
            if not len(todo):
                break
    return count, last
