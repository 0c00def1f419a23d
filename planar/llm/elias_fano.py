"""Elias-Fano sequences over numpy arrays, with vectorised access and search."""

from __future__ import annotations

import numpy as np

#: SELECT[b, k]: place of the k-th set bit of byte b.
SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    _on = [i for i in range(8) if _b >> i & 1]
    SELECT[_b, : len(_on)] = _on


class Bits:
    """A bit vector (bytes, least bit first) with counts of its set or clear bits before each 64-byte run."""

    def __init__(self, raw, of: int):
        self.raw, self.of = raw, of
        counts = np.bitwise_count(raw).astype(np.int64)
        self.per_byte = counts if of else 8 - counts
        self.before = np.concatenate([[0], np.cumsum(self.per_byte)])

    def select(self, k):
        """Places of the k-th (from 0) bits of the kind."""
        byte = np.searchsorted(self.before, k, "right") - 1
        own = self.raw[byte]
        return 8 * byte + SELECT[own if self.of else ~own, k - self.before[byte]]


class EliasFano:
    """A sequence of ascending integers below `universe` in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low, high):
        self.n, self.l, self.low, self.high = n, low_bits, low, high
        self.tops = 8 * len(high) - n  # clear bits, each the end of a run of values with the same high bits
        self._ones = self._zeros = None

    @staticmethod
    def encode(values, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        l = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if n and l:
            part = values & np.uint64((1 << l) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[starts]] |= np.bitwise_or.reduceat(part << shift, starts)
            over = shift + np.uint64(l) > np.uint64(64)  # at most one value runs over the end of a word
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        top = (values >> np.uint64(l)).astype(np.int64)
        bits = np.zeros((n + (universe >> l) + 2 + 7) // 8 * 8, np.uint8)
        bits[top + np.arange(n)] = 1
        return EliasFano(n, l, low, np.packbits(bits, bitorder="little"))

    def lows(self, i):
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        v = self.low[word] >> shift
        v |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return v & np.uint64((1 << self.l) - 1)

    def access(self, i):
        """Values at places i."""
        self._ones = self._ones or Bits(self.high, 1)
        i = np.asarray(i, np.int64)
        return ((self._ones.select(i) - i).astype(np.uint64) << np.uint64(self.l)) | self.lows(i)

    def find(self, x, first=None, last=None):
        """The place of each x among all values, or among those at places first to last (exclusive); -1 if it isn't there.

        The successor of x is sought among the values with its high bits that lie within the range."""
        self._zeros = self._zeros or Bits(self.high, 0)
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        top, low = (x >> np.uint64(self.l)).astype(np.int64), x & np.uint64((1 << self.l) - 1)
        begin, end = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        inside = np.flatnonzero(top < self.tops)
        own = top[inside]
        begin[inside] = np.where(own > 0, self._zeros.select(np.maximum(own - 1, 0)) + 1 - own, 0)
        end[inside] = self._zeros.select(own) - own
        if first is not None:
            begin, end = np.maximum(begin, first), np.minimum(end, last)
        open_ = np.flatnonzero(begin < end)
        first, last, low = begin[open_], end[open_], low[open_]
        ends = last.copy()
        live = np.arange(len(open_))
        while len(live):  # halves the bucket of each query
            mid = (first[live] + last[live]) >> 1
            less = self.lows(mid) < low[live]
            first[live[less]] = mid[less] + 1
            last[live[~less]] = mid[~less]
            live = live[first[live] < last[live]]
        inside = np.flatnonzero(first < ends)
        hit = inside[self.lows(first[inside]) == low[inside]]
        out[open_[hit]] = first[hit]
        return out

    def parts(self) -> list:
        return [np.array([self.n, self.l], np.int64), self.low, self.high]
