"""A compressed full-text index over sequences of integers: BWT in a wavelet matrix, rank by popcounts."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: words of 64 bits and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)])
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = int(len(bits) - ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        part = self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part).astype(np.int32)


class FMIndex:
    """Built over ``seq`` (symbols >= 1, 0 separates); ``depth`` bounds the patterns that can be searched."""

    def __init__(self, seq: np.ndarray, depth: int):
        n = len(seq)
        self.sa = self.suffixes(seq, depth)
        bwt = seq[self.sa - 1]  # position 0 takes the last, a separator
        self.start = np.concatenate([[0], np.cumsum(np.bincount(seq))]).astype(np.int32)
        self.levels: list[tuple[int, Bits]] = []
        low = np.arange(len(self.start) - 1, dtype=np.int32)
        base = np.zeros(len(low), np.int32)
        for k in reversed(range(max(1, int(seq.max(initial=1)).bit_length()))):
            bit = (bwt >> k) & 1
            bits = Bits(bit.astype(bool))
            self.levels.append((k, bits))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
            base = self.down(bits, (low >> k) & 1, base)
        self.base, self.n = base, n

    @staticmethod
    def suffixes(seq: np.ndarray, depth: int) -> np.ndarray:
        """Positions sorted by the ``depth`` symbols at least that follow, by prefix doubling."""
        n, rank, size = len(seq), seq.astype(np.int64), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - size)] = rank[size:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_keys = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]]))
            size *= 2
            if size >= depth:
                return order

    @staticmethod
    def down(bits: Bits, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = bits.rank(at)
        return np.where(bit == 1, bits.zeros + ones, at - ones).astype(np.int32)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` followed by what ``[low, high)`` match."""
        both, symbols = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for k, bits in self.levels:
            both = self.down(bits, (symbols >> k) & 1, both)
        both = both - self.base[symbols] + self.start[symbols]
        return both[: len(low)], both[len(low) :]

    def search(self, seq: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns ``seq[first : first + size]``, read backwards.

        A pattern that one suffix alone still matches is given up: its interval is empty."""
        low, high = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
        rows = np.arange(len(first))
        a = self.start[seq[first + size - 1]]
        b = self.start[seq[first + size - 1] + 1]
        for k in reversed(range(size - 1)):
            go = b - a > 1
            rows, a, b = rows[go], a[go], b[go]
            a, b = self.step(seq[first[rows] + k], a, b)
        go = b - a > 1
        low[rows[go]], high[rows[go]] = a[go], b[go]
        return low, high


class Minimum:
    """Least value of ranges, by a sparse table as deep as the widest range asked for."""

    def __init__(self, values: np.ndarray, widest: int):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= widest:
            half, prev = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(prev[:-half], prev[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out
