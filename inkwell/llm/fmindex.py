"""A word-level FM-index: suffix order, wavelet matrix, backward search and sampled positions."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of all suffixes of ``t`` (symbols in [0, sigma)) in order; a suffix sorts before its extensions.

    Prefix doubling: the first round sorts by as many symbols as fit into 63
    bits, later rounds sort only suffixes that still share their rank.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(sigma + 1).bit_length())
    h = max(1, min(63 // bits, 8))
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= bits
        key[: max(0, n - k)] |= t[k:] + 1
    order = np.argsort(key)
    key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone)
    while len(open_):
        p = order[open_]
        key = rank[p] * (n + 1) + rank[np.minimum(p + h, n)] + 1
        o = np.argsort(key)
        p, key = p[o], key[o]
        order[open_] = p
        new = np.empty(len(p), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[p] = open_[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of symbols in [0, 2**bits), vectorised over queries."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(bits - 1, -1, -1):
            one = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            cur = np.concatenate([zero := cur[~one], cur[one]])
            self.zeros.append(len(zero))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.counts[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def _follow(self, level: int, i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = self._ones(level, i)
        return np.where(bit, self.zeros[level] + ones, i - ones)

    def path(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` ends up at the bottom, followed along ``symbol``."""
        for level in range(self.bits):
            i = self._follow(level, i, ((symbol >> (self.bits - 1 - level)) & 1).astype(bool))
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``i``."""
        return self.path(symbol, i) - self.path(symbol, np.zeros_like(i))

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how often it occurs before ``i``."""
        symbol = np.zeros_like(i)
        for level in range(self.bits):
            bit = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & _ONE
            symbol = (symbol << 1) | bit.astype(np.int64)
            i = self._follow(level, i, bit.astype(bool))
        return symbol, i - self.path(symbol, np.zeros_like(i))


class FMIndex:
    """Search phrases of words in several texts.

    ``words`` are word hashes, ``first`` tells where each text's words begin
    (and the end). Each text is followed by a terminator of its own, so no
    phrase crosses a text's end. Every ``sample``-th position and every text's
    start is sampled, so walks back never cross a terminator.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, sample: int = 32):
        texts = len(first) - 1
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        n = len(words) + texts
        sigma = texts + len(self.vocabulary)
        t = np.empty(n, np.int64)
        where = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(first))
        t[where] = ids + texts
        stops = first[1:] + np.arange(texts)
        t[stops] = np.arange(texts)
        order = suffix_array(t, sigma)
        self.texts, self.sample = texts, sample
        self.stops = stops
        # all terminators are one symbol in the transform, for walks end before them
        last = t[order - 1]
        begin = (order == 0) | (last < texts)
        transform = np.where(begin, 0, last - texts + 1)
        self.matrix = WaveletMatrix(transform, max(1, int(len(self.vocabulary)).bit_length()))
        counts = np.bincount(ids, minlength=len(self.vocabulary))
        self.before = texts + np.concatenate([[0], np.cumsum(counts)])
        sampled = begin | (order % sample == 0)
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of word hashes: (row, word position) of all occurrences; positions count words over all texts."""
        none = np.zeros(0, np.int64)
        if not len(phrases) or not len(self.vocabulary):
            return none, none
        ids = np.minimum(np.searchsorted(self.vocabulary, phrases), len(self.vocabulary) - 1)
        row = np.flatnonzero((self.vocabulary[ids] == phrases).all(axis=1))
        ids = ids[row]
        if not len(row):
            return none, none
        lo, hi = self.before[ids[:, -1]], self.before[ids[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = ids[:, k]
            both = self.matrix.rank(np.concatenate([c, c]) + 1, np.concatenate([lo, hi]))
            lo, hi = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            live = lo < hi
            row, ids, lo, hi = row[live], ids[live], lo[live], hi[live]
            if not len(row):
                return none, none
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(row, n), self._locate(at)

    def _locate(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        todo, steps = np.arange(len(at)), 0
        while len(todo):
            done = self.marks[at + 1] > self.marks[at]
            out[todo[done]] = self.positions[self.marks[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                symbol, rank = self.matrix.access_rank(at)
                at = self.before[symbol - 1] + rank
                steps += 1
        return out - np.searchsorted(self.stops, out)  # without the terminators before it
