"""Word-level use of a public BPE tokenizer with word ends.

Its pieces never span white space, so the ids of a text are those of its words in order.
Plain words (Latin letters) are merged for many words at once; all others, and the marks after
plain ones, go to the tokenizers library, one call a distinct word.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa

from . import textnum

LONGEST = 48
NEVER = np.int32(2**31 - 1)
#: Distinct words that a task keeps at once.
WORDS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def source(path: str | None = None) -> str:
    """The tokenizer's own file as text, read on the driver; its size is fixed."""
    return Path(path or default_path()).read_text()


def load(text: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {}, 256
    for b in range(256):
        if b in plain:
            names[b] = chr(b)
        else:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class Merges:
    """Ranks of pairs in a hash table of numpy arrays; the few that collide lie in a second one."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        keys = pairs[:, 0].astype(np.uint64) << np.uint64(20) | pairs[:, 1].astype(np.uint64)
        self.merged = merged
        self.tables = []
        left = np.arange(len(keys))
        for bits in (22, 16, 16, 16):
            slots = self.slot(keys[left], bits, len(self.tables))
            _, at = np.unique(slots, return_index=True)
            table = np.full(1 << bits, len(keys), np.int32)
            table[slots[at]] = left[at]
            self.tables.append((bits, table))
            left = np.delete(left, at)
        if len(left):
            raise ValueError("pairs collide")
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    @staticmethod
    def slot(keys: np.ndarray, bits: int, which: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * which) % (1 << 64))
        return (keys * odd) >> np.uint64(64 - bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        out = np.full(keys.shape, NEVER, np.int32)
        for k, (bits, table) in enumerate(self.tables):
            at = table[self.slot(keys, bits, k)]
            hit = self.keys[at] == keys
            out[hit] = at[hit]
        return out


def entries(texts: pa.Array):
    """Distinct words of a block of texts, and their places.

    ``(bytes, first, last, key, plain, number, before)``: range and hash of each distinct word, whether it
    is plain (its letters, in lower case, without the marks after them, which are a word of their own), the
    number of the word at each place, and the places before each text."""
    data, offs = textnum.view(texts)
    first, last = textnum.spans(data, offs)
    prev = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    latin = (prev == 0xC3) & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[latin & (data <= 0x9E)] += 32
    good = ((low >= 97) & (low <= 122)) | latin
    good[:-1] |= (data[:-1] == 0xC3) & latin[1:]
    bad = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~good, out=bad[1:])
    end = textnum.unmarked(data, first, last)
    plain = (end > first) & (bad[end] == bad[first]) & (end - first <= LONGEST)
    end = np.where(plain, end, last)
    (keys,) = textnum.hashes(low, (first, end))
    odd, tails = np.flatnonzero(~plain), np.flatnonzero(end < last)
    other, marks = textnum.hashes(data, (first[odd], last[odd]), (end[tails], last[tails]))
    keys[odd] = other ^ np.uint64(0x5851F42D4C957F2D)
    # the words, each with the marks at its end behind it
    a, b = np.concatenate([first, end[tails]]), np.concatenate([end, last[tails]])
    plain = np.concatenate([plain, np.zeros(len(tails), bool)])
    keys = np.concatenate([keys, marks ^ np.uint64(0x5851F42D4C957F2D)])
    order = np.argsort(a, kind="stable")
    uniq, at, number = np.unique(keys[order], return_index=True, return_inverse=True)
    at = order[at]
    shift = np.where(plain[at], 0, len(data))
    return np.concatenate([low, data]), a[at] + shift, b[at] + shift, uniq, plain[at], number.reshape(-1), np.searchsorted(a[order], offs)


class Encoder:
    def __init__(self, text: str):
        self.tok = load(text)
        spec = json.loads(text)["model"]
        vocab, end = spec["vocab"], spec["end_of_word_suffix"]
        names = byte_names()
        self.first = np.array([vocab[n] for n in names], np.int32)
        self.last = np.array([vocab[n + end] for n in names], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        self.merges = Merges(np.array([(vocab[a], vocab[b]) for a, b in pairs]), np.array([vocab[a + b] for a, b in pairs], np.int32))
        self.clear()

    def pieces(self) -> list[str]:
        """The id-to-piece table."""
        vocab = self.tok.get_vocab(with_added_tokens=True)
        out = [""] * (max(vocab.values()) + 1)
        for p, i in vocab.items():
            out[i] = p
        return out

    def library(self, word: bytes) -> list[int]:
        return self.tok.encode(word.decode(), add_special_tokens=False).ids

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of equal size class: padded rows and lengths."""
        width = int(size.max())
        cols = np.arange(width)
        raw = data[np.minimum(start[:, None] + cols, len(data) - 1)]
        sym = np.where(cols == size[:, None] - 1, self.last[raw], self.first[raw])
        length = size.copy()
        rank = np.full((len(sym), max(1, width - 1)), NEVER, np.int32)
        ok = cols[1:] < size[:, None]
        if width > 1:
            rank[ok] = self.merges.rank(sym[:, :-1][ok], sym[:, 1:][ok])
        out = np.zeros((len(sym), width), np.int32)
        rows = np.arange(len(sym))  # of out
        while len(rows):
            at = rank.argmin(1)
            here = np.arange(len(rows))
            best = rank[here, at]
            done = best == NEVER
            if done.any():
                out[rows[done], : sym.shape[1]] = sym[done]
                keep = ~done
                rows, sym, rank, at, best = rows[keep], sym[keep], rank[keep], at[keep], best[keep]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            length[rows] -= 1
            sym[here, at] = self.merges.merged[best]
            w = sym.shape[1]
            take = np.arange(w - 1)
            sym = np.take_along_axis(sym, take + (take > at[:, None]), 1)
            if w == 2:
                rank = np.full((len(rows), 1), NEVER, np.int32)
                continue
            take = take[: w - 2]
            rank = np.take_along_axis(rank, take + (take >= at[:, None]), 1)
            n = length[rows]
            left = at > 0
            rank[here[left], at[left] - 1] = self.merges.rank(sym[here[left], at[left] - 1], sym[here[left], at[left]])
            right = at < n - 1
            rank[here[right], at[right]] = self.merges.rank(sym[here[right], at[right]], sym[here[right], at[right] + 1])
            ends = ~right & (at < w - 2)
            rank[here[ends], at[ends]] = NEVER
        return out, length

    def plain(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of plain lower-case words, in order."""
        order, lengths, parts = np.argsort(size, kind="stable"), np.zeros(len(size), np.int64), [np.zeros(0, np.int32)]
        for k in range(0, len(order), 32_768):
            rows = order[k : k + 32_768]
            ids, n = self.merge(data, start[rows], size[rows])
            parts.append(ids[np.arange(ids.shape[1]) < n[:, None]])
            lengths[rows] = n
        at = np.zeros(len(size), np.int64)
        at[order] = np.cumsum(lengths[order]) - lengths[order]
        return textnum.gather(np.concatenate(parts), at, lengths), lengths

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of a block the place and number of its ids, and the words before each text."""
        data, first, last, keys, plain, number, before = entries(texts)
        start, size = self.found(data, first, last, keys, plain)
        return start[number], size[number], before

    def lookup(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each word, given by its range."""
        (keys,) = textnum.hashes(data, (first, last))
        keys[~plain] ^= np.uint64(0x5851F42D4C957F2D)
        uniq, at, which = np.unique(keys, return_index=True, return_inverse=True)
        start, size = self.found(data, first[at], last[at], uniq, plain[at])
        return start[which.reshape(-1)], size[which.reshape(-1)]

    def found(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct words, whose hashes are sorted; new ones are encoded."""
        here = np.searchsorted(self.keys, keys)
        new = self.keys[np.minimum(here, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
        mine, rest = np.flatnonzero(new & plain), np.flatnonzero(new & ~plain)
        self.add(keys[mine], *self.plain(data, first[mine], last[mine] - first[mine]))
        own = [self.library(data[x:y].tobytes()) for x, y in zip(first[rest].tolist(), last[rest].tolist(), strict=True)]
        self.add(keys[rest], np.array([x for r in own for x in r], np.int32), np.array([len(r) for r in own], np.int64))
        here = np.searchsorted(self.keys, keys)
        return self.at[here], self.size[here]

    def add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Puts words into the table."""
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, flat])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def clear(self) -> None:
        """An empty table."""
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def encode(self, texts: pa.Array):
        """(first row, ids, offsets of the rows in ids) for each block of a batch.

        A table of distinct words is kept over the blocks of a task, up to ``WORDS`` of them: a word is
        encoded once, and each of its places takes its ids from the table."""
        for at, part in textnum.blocks(texts, 8 * textnum.BLOCK):
            if len(self.keys) > WORDS:
                self.clear()
            start, size, before = self.block(part)
            ends = np.concatenate([[0], np.cumsum(size)])
            yield at, textnum.gather(self.pool, start, size), ends[before]
