"""Phrase collocation mining by direct-address tiling.

Words of a language are ranked by frequency, and the first ``HEAD`` of all are numbered by their rank;
later ones keep a 63-bit hash as number. Pairs of two numbered words fall into square tiles of
``TILE`` x ``TILE`` cells. A task counts a tile that holds many pairs of a batch in a dense array by
``bincount`` and keeps it to its end; all other pairs are sorted and counted as coordinates (COO). The
partial counts are summed by Spark. Then the frequent pairs are ranked again, the first of them are
numbered, and a pair's number and that of the next word make the pairs of the next round: phrases of
three words, and so on. A longer phrase is counted only where both its shorter parts are frequent, which
a bitmap of fixed size answers: it may let more pass, never less, and all counts below the least go at the end.

Only the first ranks and the bitmaps reach the tasks, all of fixed size. Words of a language are told
apart from equal words of another by their numbers. If two words of the corpus share a hash, the words
are counted again with another one, so the counts are exact.

Null text: empty. Null language: ``und``. Repeated rows (also of one id) count each. Other columns
are ignored, an empty table gives no rows. Ties of score and count go by the phrase in UTF-8 byte order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textnum
from .common import lean, written

LEAST, LONGEST, TOP = 10, 3, 2000
#: Ranked words, and ranked phrases of each length; the cells of a tile are the squares of 256 ranks.
HEAD, TILE = 1 << 16, 256
#: Pairs of a batch; a tile with so many of them is dense; dense tiles that a task holds at most.
BATCH, DENSE, MOST_DENSE = 1 << 21, TILE * TILE // 4, 256
#: Bits of the filter of frequent words or phrases, and distinct words a task holds before it sends them.
FILTER_BITS, HELD = 24, 400_000
#: Parts of a language from which the first phrases are taken before they meet.
PARTS = 32

BREAKS, SEPARATORS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATORS[list(b".,;:!?\n\x0b\x0c\r \t")] = True
TOP_BIT = np.uint64(1 << 63)


def table_of(seed: int) -> np.ndarray:
    """Byte values for the hash; A-Z count as a-z."""
    return textnum.mix(textnum.byte_table(True) + np.uint64(0x2545F4914F6CDD1D * seed % (1 << 64)))


def lang_keys(langs: list[str], seed: int) -> np.ndarray:
    """A number for each language of a batch."""
    names = sorted(set(langs))
    data = pa.array(names, pa.string())
    raw, offs = textnum.view(data)
    h, = textnum.hashes(raw, (offs[:-1], offs[1:]), table=textnum.TABLE)
    own = dict(zip(names, textnum.mix(h + np.uint64(seed)).tolist(), strict=True))
    return np.array([own[x] for x in langs], np.uint64)


def split(texts: pa.Array, langs: list[str], seed: int):
    """Words of a batch of texts: ``(data, first, last, number, piece, text)``.

    ``number`` is a hash of language and word with the top bit set; words of a piece follow each other."""
    data, offs = textnum.view(texts)
    sep = SEPARATORS[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = sep
    before[offs] = True
    first = np.flatnonzero(~sep & before[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = sep
    after[offs] = True
    last = np.flatnonzero(~sep & after[1:]) + 1
    text = np.searchsorted(offs, first, "right") - 1
    h, = textnum.hashes(data, (first, last), table=table_of(seed))
    breaks = np.cumsum(BREAKS[data])[first] if len(first) else first
    piece = breaks + text  # grows wherever a piece or a text ends
    return data, first, last, textnum.mix(h ^ lang_keys(langs, seed)[text]) | TOP_BIT, piece, text


def parts_of(batches, seed: int):
    """``split`` of whole texts, about ``textnum.BLOCK`` bytes at once; also their languages."""
    for b in batches:
        langs = b.column(1).to_pylist()
        for at, part in textnum.blocks(b.column(0)):
            own = langs[at : at + len(part)]
            yield own, split(part, own, seed)


def word_counts(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``(lang, word, id, f)`` of every word of ``rows(text, lang)``."""

    def run(batches):
        def sent(held):
            number, n, flat, size, lang = (np.concatenate(x) for x in zip(*held, strict=True))
            once, at, which = np.unique(number, return_index=True, return_inverse=True)
            total = np.bincount(which.reshape(-1), weights=n, minlength=len(once)).astype(np.int64)
            start = np.cumsum(size) - size
            ends = np.concatenate([[0], np.cumsum(size[at])]).astype(np.int32)
            word = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(textnum.gather(flat, start[at], size[at]).tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(lang[at], pa.string()), word, pa.array(once.view(np.int64)), pa.array(total)], ["lang", "word", "id", "c"])

        held, count = [], 0
        for langs, (data, first, last, number, _, text) in parts_of(batches, seed):
            once, at, n = np.unique(number, return_index=True, return_counts=True)
            low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            held.append((once, n, textnum.gather(low, first[at], last[at] - first[at]), last[at] - first[at], np.array(langs, object)[text[at]]))
            count += len(once)
            if count >= HELD:
                yield sent(held)
                held, count = [], 0
        if held:
            yield sent(held)

    return rows.mapInArrow(lean(run), "lang string, word string, id long, c long").groupBy("lang", "word", "id").agg(F.sum("c").alias("f"))


class Filter:
    """A set of hashes that may hold more: one bit for each of the first ``FILTER_BITS`` bits below the top one."""

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h << np.uint64(1)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    @staticmethod
    def of(h: DataFrame) -> np.ndarray:
        """From a column ``h``; what comes to the driver are the words of 64 bits that have a bit."""
        at = F.shiftrightunsigned(F.shiftleft("h", 1), 64 - FILTER_BITS)
        rows = h.select(F.shiftright(at, 6).cast("int").alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        got = rows.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toArrow()
        out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        out[got.column("w").to_numpy()] = got.column("m").to_numpy()
        return out.view(np.uint64)

    @staticmethod
    def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = Filter.slot(h)
        return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def joined(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of a phrase, from that of its words but the last and that of the last."""
    return textnum.mix(h * np.uint64(0x9E3779B97F4A7C15) + more) | TOP_BIT


class Tiles:
    """Counts of pairs ``(left, right)`` of ranks below ``HEAD``: dense tiles by their place, the others sorted."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.held, self.count = [], 0

    def add(self, left: np.ndarray, right: np.ndarray):
        self.held.append((left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32))
        self.count += len(left)
        return self.flush() if self.count >= BATCH else None

    def flush(self):
        """Sorted pairs of the sparse tiles, and their counts; dense tiles stay."""
        code = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        self.held, self.count = [], 0
        tile = ((code >> np.uint32(24)) << np.uint32(8)) | ((code >> np.uint32(8)) & np.uint32(255))
        sizes = np.bincount(tile, minlength=TILE * TILE)
        room = MOST_DENSE - len(self.dense)
        for t in np.argsort(-sizes, kind="stable")[:room].tolist():
            if sizes[t] < DENSE:
                break
            self.dense.setdefault(t, np.zeros(TILE * TILE, np.int64))
        is_dense = np.zeros(TILE * TILE, bool)
        is_dense[list(self.dense)] = True
        own = is_dense[tile]
        cell = ((code[own] >> np.uint32(8)) & np.uint32(0xFF00)) | (code[own] & np.uint32(255))
        order = np.argsort(tile[own], kind="stable")
        cell = cell[order]
        at = np.cumsum(np.where(is_dense, sizes, 0))
        for t, counts in self.dense.items():
            counts += np.bincount(cell[at[t] - sizes[t] : at[t]], minlength=TILE * TILE)
        return np.unique(code[~own], return_counts=True)

    def rest(self):
        """What the dense tiles hold, in the same form."""
        out = [self.flush()]
        for t, counts in self.dense.items():
            cell = np.flatnonzero(counts).astype(np.uint32)
            out.append(((np.uint32(t >> 8) << np.uint32(24)) | ((cell >> np.uint32(8)) << np.uint32(16)) | (np.uint32(t & 255) << np.uint32(8)) | (cell & np.uint32(255)), counts[cell]))
        return out


def phrase_counts(rows: DataFrame, words: tuple[np.ndarray, np.ndarray], units: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> DataFrame:
    """``(w0, .., wL, c)``: partial counts of phrases one word longer than the last of ``units``.

    ``words`` are the hashes of the ranked words and their filter. Each entry of ``units`` is the same for phrases
    of 2, 3, .. words, with the ids of their words; the phrases counted are those whose two longest parts pass."""
    shared = rows.sparkSession.sparkContext.broadcast((words, units))
    length = len(units) + 2
    names = [f"w{k}" for k in range(length)]

    def run(batches):
        (heads, bits), known = shared.value
        index = textnum.Index(heads)
        tops = [textnum.Index(u[0]) for u in known]
        last_ids = known[-1][2] if known else None
        tiles, sparse, held = Tiles(), [], 0

        def row(columns, n):
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(n, pa.int64())], [*names, "c"])

        def from_tiles(code, n):
            left, right = (code >> np.uint32(16)).astype(np.int64), (code & np.uint32(0xFFFF)).astype(np.int64)
            return row([*([left] if last_ids is None else last_ids[:, left]), right], n)

        def from_sparse(found):
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            at = np.flatnonzero(new)
            return row([c[at] for c in columns], np.diff(np.append(at, len(order))))

        for _, (_, _, _, number, piece, _) in parts_of(batches, seed):
            rank = index.find(number).astype(np.int64)
            ids = np.where(rank >= 0, rank, number.view(np.int64))
            often = (rank >= 0) | Filter.has(bits, number)
            h, unit = number, rank  # phrases of one word that begin at each word
            for k, (_, own_bits, own_ids) in enumerate(known):
                n = max(0, len(number) - k - 1)
                follows = often[:n] & often[1 : n + 1] & (piece[:n] == piece[k + 1 :])
                h = joined(h[:n], number[k + 1 :])
                unit = np.full(n, -1, np.int64)
                unit[follows] = tops[k].find(h[follows])
                # a hash may be that of another phrase: the ids decide
                hit = np.flatnonzero(unit >= 0)
                for j in range(k + 2):
                    unit[hit[own_ids[j][unit[hit]] != ids[hit + j]]] = -1
                    hit = hit[unit[hit] >= 0]
                passes = follows.copy()
                passes[follows] = Filter.has(own_bits, h[follows])
                often = passes | (unit >= 0)
            n = max(0, len(number) - length + 1)
            ok = often[:n] & often[1 : n + 1] & (piece[:n] == piece[length - 1 :])
            at = np.flatnonzero(ok)
            head = (unit[at] >= 0) & (rank[at + length - 1] >= 0)
            if got := tiles.add(unit[at[head]], rank[at[head] + length - 1]):
                yield from_tiles(*got)
            at = at[~head]
            sparse.append([ids[at + j] for j in range(length)])
            held += len(at)
            if held >= BATCH:
                yield from_sparse(sparse)
                sparse, held = [], 0
        if held:
            yield from_sparse(sparse)
        for got in tiles.rest():
            yield from_tiles(*got)

    return rows.mapInArrow(lean(run), ", ".join(f"{c} long" for c in [*names, "c"]))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, head: int = HEAD) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language, all of them if ``top`` is None."""
    if longest < 2 or head > HEAD:
        raise ValueError(f"phrases have two words or more, and at most {HEAD} ranks")
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("string").alias("text"), F.coalesce(F.col(lang), F.lit("und")).cast("string").alias("lang"))
    seed = 0
    while True:
        every = written(word_counts(rows, seed), "words")
        if every.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            break
        seed += 1
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = every.where(F.col("f") >= least)
    # a fixed number of rows
    first = vocabulary.orderBy(F.desc("f"), "id").limit(head).select("id").toArrow().column("id").to_numpy()
    heads = np.ascontiguousarray(first).view(np.uint64)
    bits = Filter.of(vocabulary.select(F.col("id").alias("h")))
    spark = docs.sparkSession
    ranks = spark.createDataFrame(pa.table({"id": first, "rank": np.arange(len(first), dtype=np.int64)}))
    vocabulary = written(vocabulary.join(F.broadcast(ranks), "id", "left").select("lang", "word", "f", "id", F.coalesce("rank", "id").alias("w")), "vocabulary")
    units, levels = [], [vocabulary.select(F.col("w").alias("w0"), F.col("f").alias("a"), F.col("id").alias("h"), "lang", F.col("word").alias("phrase"))]
    last = vocabulary.select(F.col("w").alias("w"), F.col("id").alias("last_id"), F.col("word").alias("last_word"))
    for length in range(2, longest + 1):
        names = [f"w{k}" for k in range(length)]
        counts = phrase_counts(rows, (heads, bits), units, seed).groupBy(*names).agg(F.sum("c").alias("a")).where(F.col("a") >= least)
        # its words, by those of its first part and its last word
        before = levels[-1].select(*names[:-1], "lang", "phrase", F.col("h").alias("h0"))
        named = counts.join(before, names[:-1]).join(last.withColumnRenamed("w", names[-1]), names[-1])
        level = written(named.select(*names, "a", "lang", F.concat_ws(" ", "phrase", "last_word").alias("phrase"), "h0", "last_id"), f"phrases-{length}")
        levels.append(level)
        if length < longest:
            # the same hash as in the tasks, for the filter and the first ranks
            def hashed(batches, names=names):
                for b in batches:
                    h = joined(b.column("h0").to_numpy().view(np.uint64), b.column("last_id").to_numpy().view(np.uint64))
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*names, "a", "lang", "phrase")], pa.array(h.view(np.int64))], [*names, "a", "lang", "phrase", "h"])

            kinds = ", ".join(f"{c} long" for c in [*names, "a"]) + ", lang string, phrase string, h long"
            level = levels[-1] = written(level.mapInArrow(lean(hashed), kinds), f"ranked-{length}")
            got = level.orderBy(F.desc("a"), *names).limit(head).select("h", *names).toArrow()
            units.append((np.ascontiguousarray(got.column("h").to_numpy()).view(np.uint64), Filter.of(level.select("h")), np.stack([got.column(c).to_numpy() for c in names])))
    return first_phrases(scored(levels, longest), totals, top)


def scored(levels: list[DataFrame], longest: int) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the phrases that no longer one holds at half their count."""
    out = None
    part = lambda names, k, side: levels[k - 1].select(*[F.col(f"w{j}").alias(c) for j, c in enumerate(names)], F.col("a").alias(side))
    for length in range(2, longest + 1):
        names = [f"w{k}" for k in range(length)]
        level = levels[length - 1].select(*names, "a", "lang", "phrase")
        if length < longest:
            more = levels[length]
            heads = more.select(*names, F.col("a").alias("longer"))
            tails = more.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in range(length)], F.col("a").alias("longer"))
            over = heads.unionByName(tails).groupBy(*names).agg(F.max("longer").alias("longer"))
            level = level.join(over, names, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).drop("longer")
        cuts = []
        for k in range(1, length):
            level = level.join(part(names[:k], k, f"l{k}"), names[:k]).join(part(names[k:], length - k, f"r{k}"), names[k:])
            # exact: counts below 10^15, a quotient of at most a million
            score = F.expr(f"1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l{k} as decimal(15,0)) * cast(r{k} as decimal(15,0)))")
            cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        best = F.array_min(F.array(*cuts))
        rows = level.select("lang", "phrase", "a", best.alias("z")).select("lang", "phrase", "a", "z.l", "z.r", "z.score")
        out = rows if out is None else out.union(rows)
    return out


def first_phrases(rows: DataFrame, totals: DataFrame, top: int | None) -> DataFrame:
    """The first of each language with their ranks; parts of a language send their first ones only."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
g as (select lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, range(1, 4) u(k) where len(ws) >= k)),
f as materialized (select lang, phrase, any_value(k) as k, count(*) as f from g group by 1, 2),
nn as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 10),
parts as (select *, array_to_string(list_slice(ws, 1, j), ' ') as lp, array_to_string(list_slice(ws, j + 1, k), ' ') as rp from (select *, unnest(range(1, k)) as j from cand)),
cutl as materialized (select c.*, x.f as l from parts c join f x on x.lang = c.lang and x.phrase = c.lp),
cuts as materialized (select c.*, x.f as r, (1000000::hugeint * a * a // (l::hugeint * x.f))::bigint as score from cutl c join f x on x.lang = c.lang and x.phrase = c.rp),
low as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from cuts) where o = 1),
inner2 as (select lang, s as phrase, max(a) as longer from (select lang, a, unnest([array_to_string(list_slice(ws, 1, 2), ' '), array_to_string(list_slice(ws, 2, 3), ' ')]) as s from cand where k = 3) group by 1, 2),
best as (select low.*, row_number() over (partition by low.lang order by score desc, a desc, low.phrase) as rank from low left join inner2 i on i.lang = low.lang and i.phrase = low.phrase where longer is null or 100 * longer < 50 * a)
select b.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score from best b join nn on nn.lang = b.lang where rank <= 2000
"""

QUERIES = {"op11_phrases": op11_phrases}
ORACLES = {"op11_phrases": ORACLE}
