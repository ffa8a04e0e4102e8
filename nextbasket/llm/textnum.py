"""Words of a batch of texts as numpy arrays, without a Python object a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
BLOCK = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    return mix(b + np.uint64(0xA0761D6478BD642F))


TABLE, TABLE_LOWER = byte_table(False), byte_table(True)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(max(n, BLOCK), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of consecutive texts: byte range, hash, and for each text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def bytes(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def blocks(texts: pa.Array, size: int = BLOCK):
    """(first row, rows) of consecutive parts of about ``size`` bytes."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and where each begins in them (and the last ends)."""
    texts = texts.fill_null("")
    offs = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data) + 1, bool)
    before[1:] = space
    before[offs] = True  # a text starts anew
    first = np.flatnonzero(~space & before[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    after[offs] = True
    return first, np.flatnonzero(~space & after[1:]) + 1


def hashes(data: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray], table: np.ndarray = TABLE) -> list[np.ndarray]:
    """A 64-bit hash of the bytes of each range, for several arrays of (first, end)."""
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p[:-1], out=total[1:])
    return [mix((total[last] - total[first]) * q[first] + (last - first).astype(np.uint64)) for first, last in ranges]


#: ASCII marks; white space, letters, digits and apostrophes are none.
MARKS = np.zeros(256, bool)
MARKS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def unmarked(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ends of the words without the marks at their ends; a word of marks only becomes empty."""
    stop = np.zeros(len(data) + 1, np.int64)  # the byte after the last one up to here that is no mark
    np.maximum.accumulate(np.where(MARKS[data], 0, np.arange(1, len(data) + 1)), out=stop[1:])
    return np.maximum(stop[last], first)


def words(texts: pa.Array, lower: bool = False, marks: bool = True) -> Words:
    """Splits at ASCII white space; null has no words. ``marks=False`` leaves out marks at the ends of words."""
    data, offs = view(texts)
    first, last = spans(data, offs)
    if not marks:
        last = unmarked(data, first, last)
    return Words(data, first, last, *hashes(data, (first, last), table=TABLE_LOWER if lower else TABLE), np.searchsorted(first, offs))


def hashes_of(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of elements."""
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[:-1], out=total[1:])
    return mix((total[last] - total[first]) * q[first] + (last - first).astype(np.uint64))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive elements, in order; element i covers i .. i + k - 1."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of ``pool`` one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class Index:
    """Positions of distinct 64-bit keys, by hashing; keys that collide lie in smaller tables after the first."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.append(keys, np.uint64(0))
        self.tables: list[tuple[int, np.ndarray]] = []
        left = np.arange(len(keys))
        while len(left):
            slots = self.slot(keys[left], bits, len(self.tables))
            _, at = np.unique(slots, return_index=True)
            table = np.full(1 << bits, len(keys), np.int32)
            table[slots[at]] = left[at]
            self.tables.append((bits, table))
            left, bits = np.delete(left, at), 16

    @staticmethod
    def slot(keys: np.ndarray, bits: int, which: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * which) % (1 << 64))
        return (keys * odd) >> np.uint64(64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if it is none."""
        out = np.full(keys.shape, -1, np.int32)
        none = len(self.keys) - 1
        for k, (bits, table) in enumerate(self.tables):
            at = table[self.slot(keys, bits, k)]
            hit = (self.keys[at] == keys) & (at != none)
            out[hit] = at[hit]
        return out
