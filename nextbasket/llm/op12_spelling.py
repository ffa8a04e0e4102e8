"""Spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced letter makes one of the other. The bigrams of a word are
ordered by how many words hold them, rarest first; the words' letters allow some eight thousand bigrams, so
this order has a fixed size. The prefix of a word are its three rarest bigrams (and equal ones), and its
pivots two of these that do not overlap, chosen by dynamic programming so that the cost of their lists is least.
One edit breaks one pivot at most. Of two near words the one whose prefix ends with the rarer bigram has all
its pivots in front of the other's last, so a pivot that is left is found in the other's prefix.

Where it is found there is limited: an edit to its right leaves it, and all letters before it, in place; an
edit to its left moves it with all letters behind it by the difference of the lengths. So lists go by the
bigram together with all letters on its unchanged side. If the edit is not outside both pivots, the letters
beyond the other pivot are unchanged too; up to four of them belong to the list's key, and a prefix is entered for
each number of them in ``REACH``. Every pair of a list is verified.

Lists of more than ``CAP`` pivots are cut by hash into parts that meet the whole list of prefixes each.
Prefixes stream past the pivots of a part, so that no list is held by a task.

Null text: no words. Null id: as an empty one. Repeated rows (also of one id) count each. Ties of the
largest count: the smallest word. Other columns are ignored, an empty table gives no rows. Equal words of a batch of
texts are found by a 64-bit hash, all others by the word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .common import lean, written

SHORTEST, LEAST, DAMAGED, RATIO = 7, 2, 31, 10
#: Bigrams of a prefix; letters beyond the other pivot that belong to a key.
PREFIX, REACH = 3, (0, 1, 2, 4)
#: Pivots of a list that a task holds; pairs that are verified at once; letters above which words are compared one by one.
CAP, PAIRS, WIDE = 2000, 40_000, 40
#: Distinct words a task holds before it sends them.
HELD = 150_000
LETTER = np.zeros(256, bool)
LETTER[list(range(65, 91)) + list(range(97, 123))] = True
LEAD = 0xC3  # the first byte of every letter from U+00C0 to U+00FF


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


CRC = crc_table()


def crc_of(data: np.ndarray, first: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes, continued from that of the bytes before it."""
    size = last - first
    order = np.argsort(-size, kind="stable")
    ranked, start = size[order], first[order]
    c = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for k in range(min(int(size.max(initial=0)), WIDE)):
        m = int(np.searchsorted(-ranked, -k))
        c[:m] = CRC[(c[:m] ^ data[start[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for j in range(int(np.searchsorted(-ranked, -WIDE))):
        c[j] = zlib.crc32(data[start[j] + WIDE : start[j] + ranked[j]].tobytes(), int(c[j]))
    out = np.empty(len(c), np.uint32)
    out[order] = c
    return out


def runs_of(keys: list, texts: pa.Array):
    """Lower-cased bytes of the texts, and ``(first, last, letters, h)`` of each run of letters."""
    data, offs = textnum.view(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    lead = data == LEAD
    letter = LETTER[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = ~letter
    edge[offs] = True
    first = np.flatnonzero(letter & edge[:-1])
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = ~letter
    edge[offs] = True
    last = np.flatnonzero(letter & edge[1:]) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    letters = last - first - (leads[last] - leads[first])
    begun = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32)
    h = crc_of(data, first, last, begun[np.searchsorted(offs, first, "right") - 1])
    return data, first, last, letters, h


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, damaged: int = DAMAGED) -> DataFrame:
    """``(word, n)`` of words of ``shortest`` letters or more, one letter of every ``damaged``-th run deleted."""

    def run(batches):
        def sent(held, odd):
            h, n, flat, size = (np.concatenate(x) for x in zip(*held, strict=True))
            once, at, which = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(which.reshape(-1), weights=n, minlength=len(once)).astype(np.int64)
            start = np.cumsum(size) - size
            ends = np.concatenate([[0], np.cumsum(size[at])]).astype(np.int32)
            words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(textnum.gather(flat, start[at], size[at]).tobytes())])
            yield pa.RecordBatch.from_arrays([words, pa.array(total)], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), pa.array(list(odd.values()), pa.int64())], ["word", "n"])

        held, odd, count = [], {}, 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, part in textnum.blocks(b.column(1)):
                data, first, last, letters, h = runs_of(ids[at : at + len(part)], part)
                hit = h % damaged == 0
                for k in np.flatnonzero(hit & (letters > shortest)).tolist():
                    w, cut = data[first[k] : last[k]].tobytes().decode(), int(h[k]) % int(letters[k])
                    w = w[:cut] + w[cut + 1 :]
                    odd[w] = odd.get(w, 0) + 1
                own = np.flatnonzero(~hit & (letters >= shortest))
                first, last = first[own], last[own]
                word, = textnum.hashes(data, (first, last))
                once, of, n = np.unique(word, return_index=True, return_counts=True)
                size = last[of] - first[of]
                held.append((once, n, textnum.gather(data, first[of], size), size))
                count += len(once)
                if count + len(odd) >= HELD:
                    yield from sent(held, odd)
                    held, odd, count = [], {}, 0
        if held:
            yield from sent(held, odd)

    rows = docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a letter (Latin-1) of all words, and where each begins."""
    data, offs = textnum.view(words)
    lead = data == LEAD
    leads = np.concatenate([[0], np.cumsum(lead)])
    after = np.concatenate([[False], lead[:-1]]) if len(lead) else lead
    return np.where(after, data + 0x40, data).astype(np.uint8)[~lead], offs - leads[offs]


def grams_of(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of the words, with their word and place."""
    word = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.arange(len(flat))
    inner = at < offs[word + 1] - 1
    at, word = at[inner], word[inner]
    return flat[at].astype(np.int64) << 8 | flat[at + 1], word, at - offs[word]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of all words are each of the 65,536."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(grams_of(*letters_of(b.column(0)))[0], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["gram", "c"])

    got = words.select("word").mapInArrow(lean(run), "gram int, c long").groupBy("gram").agg(F.sum("c").alias("c")).toArrow()  # a row a bigram
    out = np.zeros(1 << 16, np.int64)
    out[got.column("gram").to_numpy()] = got.column("c").to_numpy()
    return out


def chosen(flat: np.ndarray, offs: np.ndarray, counts: np.ndarray, rank: np.ndarray):
    """Prefixes ``(word, place)``, the rank of each prefix's last bigram, and the places of both pivots."""
    gram, word, place = grams_of(flat, offs)
    own, n = rank[gram], np.diff(offs)
    order = np.lexsort((place, own, word))
    begin = np.searchsorted(word, np.arange(len(n)))
    three = order[begin[:, None] + np.arange(PREFIX)]  # the rarest
    last = own[three[:, -1]]
    inside = own <= last[word]
    # costs by place: rare bigrams, and many letters on either side, have short lists
    rarest = np.sort(three, axis=1)  # by place
    at = place[rarest]
    cost = counts[gram[rarest]] * (4.0 ** -np.minimum(at + 2, 9) + 4.0 ** -np.minimum(n[:, None] - at, 9))
    # least cost of one bigram that ends before each, then of two: the best pair ends at the second or the third
    one = np.full(cost.shape, np.inf)
    from_ = np.zeros(cost.shape, np.int64)
    for j in range(1, PREFIX):
        for i in range(j):
            better = (at[:, j] - at[:, i] >= 2) & (cost[:, i] < one[:, j])
            one[better, j], from_[better, j] = cost[better, i], i
    second = np.argmin(one + cost, axis=1)
    row = np.arange(len(n))
    return (word[inside], place[inside]), last, at[row, from_[row, second]], at[row, second]


def entries(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """``(key, pivot, last, n, word)``: pivots and prefixes of the words; ``word`` has a byte a letter."""
    order = np.lexsort((np.arange(len(counts)), counts))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    shared = words.sparkSession.sparkContext.broadcast((counts, rank))
    reach = np.array(REACH)

    def keys(flat, offs, word, place, right, size):
        """Keys of bigrams with all letters to their left (or right), and ``size`` letters at the other end."""
        start, end = offs[word], offs[word + 1]
        near = (np.where(right, start + place, start), np.where(right, end, start + place + 2))
        far = (np.where(right, start, end - size), np.where(right, start + size, end))
        a, b = textnum.hashes(flat, near, far)
        return textnum.mix(a ^ textnum.mix(b + (2 * size + right).astype(np.uint64))).view(np.int64)

    def run(batches):
        counts, rank = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                flat, offs = letters_of(part.column(0))
                n = np.diff(offs)
                (word, place), last, a, z = chosen(flat, offs, counts, rank)
                every = np.arange(len(n))
                side = lambda right, k: np.full(len(k), right)
                found = [(keys(flat, offs, w, p, side(right, w), s), w, True) for w, p, right, s in (
                    (every, z, False, 0 * z), (every, a, True, 0 * a), (every, a, False, reach[np.searchsorted(reach, n - z - 2, "right") - 1]), (every, z, True, reach[np.searchsorted(reach, a, "right") - 1]),
                )]
                for k in REACH:
                    ok = n[word] - place - 2 >= k
                    found.append((keys(flat, offs, word[ok], place[ok], side(False, word[ok]), np.full(ok.sum(), k)), word[ok], False))
                    ok = place >= k
                    found.append((keys(flat, offs, word[ok], place[ok], side(True, word[ok]), np.full(ok.sum(), k)), word[ok], False))
                key, w = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                pivot = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
                size = n[w]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(textnum.gather(flat, offs[w], size).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pivot), pa.array(last[w], pa.int32()), pa.array(part.column(1).to_numpy()[w]), blob], ["key", "pivot", "last", "n", "word"])

    return words.select("word", "n").mapInArrow(lean(run), "key long, pivot boolean, last int, n long, word binary")


def near(flat: np.ndarray, offs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Are the words ``a`` and ``b`` of each pair one edit apart?"""
    n, m = offs[a + 1] - offs[a], offs[b + 1] - offs[b]
    longest = np.maximum(n, m)
    out = np.zeros(len(a), bool)
    wide = np.flatnonzero(longest > WIDE)
    for k in wide.tolist():
        x, y = flat[offs[a[k]] : offs[a[k] + 1]], flat[offs[b[k]] : offs[b[k] + 1]]
        s = min(len(x), len(y))
        head = int(np.argmin(np.append(x[:s] == y[:s], False)))
        tail = int(np.argmin(np.append(x[::-1][:s] == y[::-1][:s], False)))
        out[k] = head + tail >= longest[k] - 1 and not (len(x) == len(y) == head)
    own = np.flatnonzero(longest <= WIDE)
    if not len(own):
        return out
    a, b, n, m, longest = a[own], b[own], n[own], m[own], longest[own]
    width, short = int(longest.max(initial=0)), np.minimum(n, m)
    padded = np.concatenate([np.zeros(WIDE, np.uint8), flat, np.zeros(WIDE, np.uint8)])
    step = np.arange(width, dtype=np.int32)
    offs = offs.astype(np.int32)  # a batch of words has less than 2 ** 31 letters

    def common(x, y, sign):
        same = padded[x[:, None] + sign * step] == padded[y[:, None] + sign * step]
        return np.minimum(np.where(same.all(axis=1), width, np.argmin(same, axis=1)), short)

    head = common(offs[a] + WIDE, offs[b] + WIDE, 1)
    tail = common(offs[a + 1] - 1 + WIDE, offs[b + 1] - 1 + WIDE, -1)
    out[own] = (head + tail >= longest - 1) & ~((n == m) & (head == n))
    return out


def matched(rows: DataFrame) -> DataFrame:
    """``(word, n, other, m)`` of near words that meet in a list, each pair in one order, some more than once."""

    def run(batches):
        held = None  # pivots of the last key so far
        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None and held.num_rows and b.num_rows:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            t = t.combine_chunks()
            key, part, pivot = (t.column(c).to_numpy() for c in ("key", "part", "pivot"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            group = np.cumsum(new)
            left, right = np.flatnonzero(pivot), np.flatnonzero(~pivot)
            held = t.take(left[group[left] == group[-1]])
            low, high = np.searchsorted(group[left], group[right]), np.searchsorted(group[left], group[right], "right")
            some = high > low
            right, low, high = right[some], low[some], high[some]
            words = t.column("word").combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            flat, offs = textnum.view(words.cast(pa.large_binary()))
            last, n = t.column("last").to_numpy(), t.column("n").to_numpy()
            size, done = np.diff(offs), np.cumsum(high - low)
            at = 0
            while at < len(right):
                to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
                k = high[at:to] - low[at:to]
                y = np.repeat(right[at:to], k)
                x = left[np.repeat(low[at:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                at = to
                ok = (last[x] <= last[y]) & (np.abs(size[x] - size[y]) <= 1)
                x, y = x[ok], y[ok]
                ok = near(flat, offs, x, y)
                x, y = x[ok], y[ok]
                if len(x):
                    text = lambda k: pa.array([flat[s:e].tobytes().decode("latin-1") for s, e in zip(offs[k].tolist(), offs[k + 1].tolist(), strict=True)], pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([text(x), pa.array(n[x]), text(y), pa.array(n[y])], ["word", "n", "other", "m"])

    return rows.mapInArrow(lean(run), "word string, n long, other string, m long")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, other, m)``: every near word of each word of ``words(word, n)``, with its count."""
    rows = entries(words, gram_counts(words))
    hot = written(rows.where("pivot").groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CAP).select("key", F.ceil(F.col("k") / CAP).cast("int").alias("parts")), "long-lists")
    n_hot = hot.count()
    if n_hot:
        dealt = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = F.when(F.col("pivot"), F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = dealt.withColumn("part", F.explode(mine)).drop("parts")
    else:
        rows = rows.withColumn("part", F.lit(0))
    rows = rows.repartition("key", "part").withColumn("prefix", ~F.col("pivot")).sortWithinPartitions("key", "part", "prefix").drop("prefix")
    both = F.array(F.struct(F.col("word").alias("word"), F.col("other").alias("other"), F.col("m").alias("m")), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("m")))
    return matched(rows).select(F.inline(both)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: each step doubles the way, and counts grow along it."""
    up = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        top = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        step = written(up.join(top, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, least: int = LEAST, damaged: int = DAMAGED, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    if shortest < PREFIX + 2:
        raise ValueError(f"words need {PREFIX + 2} letters, so that both of two near ones have {PREFIX} bigrams")
    words = written(word_counts(docs, text, key, shortest, damaged).where(F.col("n") >= least), "words")
    pairs = near_words(words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("z"))
    rows = words.join(best.select("word", "n_near", F.col("z.other").alias("other"), (-F.col("z.m")).alias("m")), "word", "left")
    has = F.col("m") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("other")).alias("form"), F.when(has, F.col("m")).alias("form_n")), "near")
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op12_spelling": op12_spelling}
ORACLES: dict[str, str] = {}
