"""Compressed FM-index over word sequences: wavelet matrix, backward search, matching statistics.

An index keeps bit vectors (the wavelet levels, and where groups of equal windows begin) and
one number a symbol and a group. The suffix array is gone once it is built: whether and
where a query matches is told in the query's own positions.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with counts per 64-bit word; rank in constant time, for many positions at once."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Wavelet tree in matrix form: one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.bits.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        every = np.arange(sigma, dtype=np.int64)
        self.start = self._descend(every, np.zeros(sigma, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].rank(at)
            high = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(high, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, at) - self.start[symbol]


class FmIndex:
    """Index of several word sequences (symbols from 1 up), each ended by a separator of its own.

    ``window`` is the match length that matters. Suffixes are sorted by a little more than
    their first ``window`` words only, which is enough to search for as many.
    """

    def __init__(self, sequences: list[np.ndarray], window: int):
        self.window = window
        text = np.concatenate([x for s in sequences for x in (s, [0])] or [[0]]).astype(np.int64)
        n = self.size = len(text)
        self.sigma = int(text.max()) + 1
        breaks = np.flatnonzero(text == 0)
        # Separators rank first and differ from each other, so no match runs over one.
        rank = text + len(breaks)
        rank[breaks] = np.arange(len(breaks))
        order, width = np.argsort(rank), 1
        while True:
            now = rank[order]
            step = np.concatenate([[0], np.cumsum(now[1:] != now[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = step
            if width <= window:
                agreed, base = width, rank
            if width > window or step[-1] == n - 1:
                break
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            rank = rank * (n + 1) + after
            order = np.argsort(rank)
            width *= 2
        # Neighbours in the order that agree in ``window`` words form a group.
        a, b = order[:-1], order[1:]
        end = np.minimum(np.arange(n) + window - agreed, n - 1)
        same = (base[a] == base[b]) & (base[end[a]] == base[end[b]]) & (np.maximum(a, b) + window <= n)
        heads = np.concatenate([[True], ~same])
        self.heads = BitVector(heads)
        self.first = np.append(np.flatnonzero(heads), n).astype(np.int32)
        self.wavelet = WaveletMatrix(text[order - 1], self.sigma)
        counts = np.bincount(text, minlength=self.sigma)
        self.below = np.cumsum(counts) - counts

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step of many intervals: the occurrences with a symbol put in front."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.below[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def count(self, pattern: np.ndarray) -> int:
        """Occurrences of a pattern of at most ``window`` words."""
        lo, hi = np.array([0]), np.array([self.size])
        for c in pattern[::-1]:
            if not 0 < c < self.sigma:
                return 0
            lo, hi = self.extend(np.array([c]), lo, hi)
        return int(hi[0] - lo[0])

    def occurring(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, piece: int = 16) -> np.ndarray:
        """Where in ``flat`` a window starts that the index has; queries are given by start and length.

        Matching statistics from each query's end: a step puts a word in front of the match, and
        a match of more than ``window`` words falls back to its first ``window``. Where a word
        can't stand in front, the match starts anew one word earlier, or before a word that the
        index lacks. Queries are cut into pieces of a few windows, which all go ahead together.
        """
        found = np.zeros(len(flat), dtype=bool)
        flat = np.where((flat > 0) & (flat < self.sigma), flat, 0)
        count = np.maximum(0, -(-(lengths - self.window + 1) // piece))
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(starts, count) + nth * piece
        end = np.minimum(np.repeat(starts + lengths, count), begin + piece + self.window - 1)
        # Of each piece still under way: first place, next place, matched words and their interval.
        at, m, lo, hi = end - 1, np.zeros_like(end), np.zeros_like(end), np.full_like(end, self.size)
        while len(at):
            c = flat[at]
            new_lo, new_hi = self.extend(c, lo, hi)
            ok = (new_hi > new_lo) & (c > 0)
            full = np.flatnonzero(ok & (m + 1 >= self.window))
            found[at[full]] = True
            group = self.heads.rank(new_lo[full] + 1) - 1
            new_lo[full], new_hi[full] = self.first[group], self.first[group + 1]
            anew = np.where(c > 0, at + m, at)  # where a match that starts anew ends
            at = np.where(ok, at, anew) - 1
            m = np.where(ok, np.minimum(m + 1, self.window), 0)
            lo, hi = np.where(ok, new_lo, 0), np.where(ok, new_hi, self.size)
            left = np.flatnonzero((at >= begin) & (at + 1 + m - begin >= self.window))
            begin, at, m, lo, hi = begin[left], at[left], m[left], lo[left], hi[left]
        return found
