"""FM-index over a sequence of small integers: suffix order, wavelet matrix ranks, sampled positions.

Everything is vectorised over many patterns at once. The suffix order is exact: ranks start from the first symbols
packed into one word and are doubled, at each step only for the suffixes that are still tied."""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of ``s`` in the order of the suffixes that start there; a shorter suffix comes first."""
    n = len(s)
    bits = max(int(symbols).bit_length(), 1)
    depth = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key <<= np.uint64(bits)
        if k < n:
            key[: n - k] |= (s[k:] + 1).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    while True:
        single = new & np.concatenate([new[1:], [True]])
        tied = np.nonzero(~single)[0]
        if not len(tied):
            return order
        at = order[tied]
        after = at + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.lexsort((second, first[tied]))
        order[tied] = at[again]
        group, second = first[tied][again], second[again]
        start = np.empty(len(tied), bool)
        start[0] = True
        start[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[tied] = start
        first[tied] = np.maximum.accumulate(np.where(start, tied, 0))
        rank[order[tied]] = first[tied]
        depth *= 2


class WaveletMatrix:
    """Rank of any symbol at any position, one bit level at a time."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(int(symbols - 1).bit_length(), 1)
        cur = s.astype(np.int32)
        for b in reversed(range(self.bits)):
            bit = (cur >> b) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(cur) - int(ones[-1])
            self.levels.append((ones, zeros))
            up = bit.astype(bool)
            cur = np.concatenate([cur[~up], cur[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` before each position ``at``."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(self.levels):
            up = (symbol >> (self.bits - 1 - k)) & 1 == 1
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(up, zeros + lo1, lo - lo1)
            hi = np.where(up, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out, cur = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in self.levels:
            up = ones[cur + 1] - ones[cur]
            out = (out << 1) | up
            cur = np.where(up == 1, zeros + ones[cur], cur - ones[cur])
        return out


class FMIndex:
    """Backward search and location over ``s`` (symbols 1 .. symbols-1; 0 is the end mark, added here)."""

    def __init__(self, s: np.ndarray, symbols: int, step: int = 8) -> None:
        s = np.concatenate([s.astype(np.int64), [0]])
        order = suffix_order(s, symbols)
        self.wavelet = WaveletMatrix(s[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        sampled = order % step == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the patterns: one row each, of which the first ``lengths`` symbols count."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.before[-1], np.int64)
        for k in reversed(range(patterns.shape[1])):
            on = np.nonzero((lengths > k) & (hi > lo))[0]
            if len(on):
                c = patterns[on, k]
                lo[on] = self.before[c] + self.wavelet.rank(c, lo[on])
                hi[on] = self.before[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in ``s`` of rows of the suffix order, by walking back to the next sampled suffix."""
        at, out = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            cur = at[todo]
            hit = self.sample_rank[cur + 1] > self.sample_rank[cur]
            out[todo[hit]] = self.samples[self.sample_rank[cur[hit]]] + steps
            todo, cur = todo[~hit], cur[~hit]
            if len(todo):
                c = self.wavelet.access(cur)
                at[todo] = self.before[c] + self.wavelet.rank(c, cur)
            steps += 1
        return out
