"""N-gram Jaccard join by parity sketches.

A document is its set of shingles. Two sets that reach the similarity differ in at most ``d``
shingles, ``d`` growing with their sizes. In each size band the shingles are hashed to more
than ``d`` chunks and XORed there: a chunk of the sketch differs only if a shingle in it does,
so the number of differing chunks is a lower bound of the symmetric difference, and by the
pigeonhole principle two linked sets have an equal chunk. Equal chunks give the candidates,
which are verified by the exact sizes of intersection and union. Sets near the upper end of a
band enter the next one as well.

Sets with an equal chunk meet in a run. Runs of the same sets collapse to one, and there wide
bit sketches (about a bit a shingle) are compared: their Hamming distance is a lower bound of
the symmetric difference too. What passes forms clusters, in which the sets themselves are
compared. Large runs and clusters are dealt as blocks that share a pivot. Each block is compared
with itself and reports a spanning forest; only where several roots are left do blocks of
different roots meet. So no group emits its pairs and no link between components is lost.

Null text and texts without a word have an empty set and link with nothing. A row with null
doc_id has null component_id. Rows that share a doc_id are taken for one document with several
texts. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .common import Forest, connected, cross_blocks, grouped, lean, written

SHINGLE, PERCENT, RATIO, SEEN, RUN_SETS = 4, 85, 1.6, 500_000, 1_000_000
#: Sets of a block whose sketches are compared, and of one whose shingles are.
SKETCH_SETS, BLOCK_SETS = 1024, 128


#: Bits of a key that hold the size band.
BAND = np.uint64(127)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and where each text's begin."""
    w = textnum.words(texts, lower=True)
    n = np.diff(w.offsets)
    doc = w.doc()
    grams = textnum.runs(w.hash, k)
    ok = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = textnum.hashes_of(w.hash, w.offsets[short], w.offsets[short + 1])
    h, d = np.concatenate([grams[ok], whole]), np.concatenate([doc[: len(grams)][ok], short])
    order = np.lexsort([h, d])
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(texts) + 1))


def most_differing(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Size bands: their lower ends, and the chunks of a sketch in each."""

    def __init__(self, percent: int, ratio: float = RATIO):
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, math.floor(self.low[-1] * ratio)))
        self.low = np.array(self.low)
        high = self.low[1:] - 1
        d = np.array([most_differing(int(h), int(h), percent) for h in high])
        #: Chunks that a sketch may have empty without losing a candidate.
        self.spare = np.where(d > 0, 1 + d // 16, 0)
        self.chunks = d + 1 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def entered(n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) for every band that a set enters: its own, and the next if a linked set can lie there."""
    some = np.flatnonzero(n > 0)
    band = bands.of(n[some])
    up = (n[some] * 100 // bands.percent) >= bands.low[band + 1]
    rows, band = np.concatenate([some, some[up]]), np.concatenate([band, band[up] + 1])
    order = np.argsort(rows, kind="stable")
    return rows[order], band[order]


def wide_sketches(h: np.ndarray, offs: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(set, band, bits) with about as many bits as the band's largest set has shingles."""
    n = np.diff(offs)
    rows, band = entered(n, bands)
    words = (bands.low[band + 1] + 63) // 64
    base = np.cumsum(words) - words
    token = textnum.mix(textnum.gather(h, offs[rows], n[rows]) ^ np.uint64(0x165667B19E3779F9))
    bit = (token % np.repeat(words * 64, n[rows]).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, np.repeat(base, n[rows]) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return rows, band, [out[b : b + w].tobytes() for b, w in zip(base.tolist(), words.tolist(), strict=True)]


def sketch_keys(h: np.ndarray, offs: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketches' chunks, with the band in the lowest bits, and where each set's begin."""
    n = np.diff(offs)
    rows, band = entered(n, bands)
    size, chunks = n[rows], bands.chunks[band]
    token = textnum.gather(h, offs[rows], size)
    base = np.cumsum(chunks) - chunks
    at = np.repeat(base, size) + (textnum.mix(token ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.repeat(chunks, size).astype(np.uint64)).astype(np.int64)
    sketch = np.zeros(int(chunks.sum()), np.uint64)
    np.bitwise_xor.at(sketch, at, token)
    full = np.bincount(at, minlength=len(sketch)) > 0
    which = np.repeat(np.arange(len(rows)), chunks)
    empty = np.bincount(which[~full], minlength=len(rows))
    keep = full | (empty > bands.spare[band])[which]
    chunk = np.arange(len(sketch)) - np.repeat(base, chunks)
    key = textnum.mix(sketch ^ textnum.mix((band[which] * (1 << 32) + chunk).astype(np.uint64) + np.uint64(7)))
    key = key & ~BAND | band[which].astype(np.uint64)
    return key[keep], np.searchsorted(rows[which[keep]], np.arange(len(n) + 1))


def signatures(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textnum.mix(h ^ np.uint64(0x27D4EB2F165667C5)), dtype=np.uint64)])
    return textnum.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64)).view(np.int64)


def sets_of(docs: DataFrame, text: str, key: str, k: int, percent: int) -> DataFrame:
    """``(doc, n, s, sketches)``: set size, a hash of the set, and its wide sketch for each band."""
    kind = pa.struct([("band", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        bands = Bands(percent)
        for b in batches:
            for at, part in textnum.blocks(b.column(1)):
                h, offs = shingle_sets(part, k)
                rows, band, bits = wide_sketches(h, offs, bands)
                flat = pa.StructArray.from_arrays([pa.array(band, pa.int64()), pa.array(bits, pa.binary())], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(part) + 1)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(np.diff(offs), pa.int64()), pa.array(signatures(h, offs)), lists], ["doc", "n", "s", "sketches"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "doc long, n long, s long, sketches array<struct<band: long, bits: binary>>")


def chunk_keys(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """``(key, s)`` for every chunk of the sketches; a task sends a set that it has just seen no second time."""

    def run(batches):
        bands, seen = Bands(percent), set()
        for b in batches:
            for _, part in textnum.blocks(b.column(0)):
                h, offs = shingle_sets(part, k)
                s, n = signatures(h, offs), np.diff(offs)
                if len(seen) > SEEN:
                    seen.clear()
                new = [not (x in seen or seen.add(x)) for x in s.tolist()]
                at = np.flatnonzero(np.array(new) & (n > 0))
                keys, ends = sketch_keys(textnum.gather(h, offs[at], n[at]), np.concatenate([[0], np.cumsum(n[at])]), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(s[at], np.diff(ends)))], ["key", "s"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "key long, s long")


def runs(keys: DataFrame, block: int) -> DataFrame:
    """``(run, block, s, pivot)``: the sets that share a chunk, in blocks, once for all chunks shared by just the same sets.

    The smallest set of a run is its pivot. The band is in the lowest bits of ``run``. A run of more than ``RUN_SETS``
    sets is sent on in parts as it is read, under the name of its own chunk."""

    def run(batches):
        held_key, held, pivot, sent = None, np.zeros(0, np.int64), 0, 0

        def dealt(name, s, n, pivot, sent):
            """Rows of runs of ``n`` sets each, of which ``sent`` went out before."""
            at = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sent, n)
            cols = np.repeat(name, n), np.maximum(at - 1, 0) // block, s, np.repeat(pivot, n)
            return pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["run", "block", "s", "pivot"])

        def closed(key, s):
            """Rows of whole runs: at least two sets each."""
            new = np.append(True, (key[1:] != key[:-1]) | (s[1:] != s[:-1]))
            key, s = key[new], s[new]
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(edge, len(key)))
            total = np.add.reduceat(textnum.mix(s.view(np.uint64)), edge)
            name = (textnum.mix(total) & ~BAND | key[edge].view(np.uint64) & BAND).view(np.int64)
            keep = n > 1
            _, once = np.unique(name[keep], return_index=True)
            some = np.flatnonzero(keep)[once]
            s = textnum.gather(s, edge[some], n[some])
            return dealt(name[some], s, n[some], s[np.cumsum(n[some]) - n[some]], np.zeros(len(some), np.int64))

        def part():
            """What is held of a long run."""
            s = np.unique(held)
            return dealt(np.array([held_key]), s, np.array([len(s)]), np.array([pivot if sent else s[0]]), np.array([sent])), len(s)

        for b in batches:
            key, s = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            if key[0] != held_key and len(held):
                yield part()[0] if sent else closed(np.full(len(held), held_key), held)
                held, sent = held[:0], 0
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                first = int(np.searchsorted(key, key[0], "right")) if sent else 0
                if sent:
                    held = np.concatenate([held, s[:first]])
                    yield part()[0]
                    held, sent = held[:0], 0
                if cut > first:
                    yield closed(np.concatenate([np.full(len(held), key[0]), key[first:cut]]), np.concatenate([held, s[first:cut]]))
                held = held[:0]
            held_key, held = key[-1], np.concatenate([held, s[cut:]])
            if len(held) > RUN_SETS:
                tail = held[held == held[-1]]  # may go on in the next batch
                held = held[held != held[-1]]
                if len(held):
                    pivot = pivot if sent else held[0]
                    rows, n = part()
                    yield rows
                    sent += n
                held = tail
        if len(held):
            yield part()[0] if sent else closed(np.full(len(held), held_key), held)

    rows = keys.repartition(F.col("key")).sortWithinPartitions("key", "s")
    return rows.mapInArrow(lean(run), "run long, block long, s long, pivot long").distinct()


def spread(members: DataFrame, block: int) -> DataFrame:
    """``(cluster, block, s, pivot)`` for rows ``(cluster, s)``; a cluster is named by its smallest set, the pivot."""
    sizes = written(members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks")), "sizes")
    own = F.when(F.col("s") == F.col("cluster"), 0).otherwise(F.pmod(F.xxhash64("s", F.lit(17)), F.col("blocks")))
    return members.join(sizes, "cluster").select("cluster", own.alias("block"), "s", F.col("cluster").alias("pivot"))


def passing(members: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges between roots that join the sets of each group of ``(g, left, right, s, root, n, bits)``
    whose wide sketches don't rule out a link."""

    def run(batches):
        for t in grouped(batches):
            if t.num_rows < 2:
                continue
            s, n, left, right = (t.column(c).to_numpy() for c in ("s", "n", "left", "right"))
            name, root = np.unique(t.column("root").to_numpy(), return_inverse=True)
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(s), -1)
            forest, out = Forest(int(root.max()) + 1), []
            for a in range(len(s) - 1):
                if forest.trees == 1:
                    break
                far = np.bitwise_count(bits[a] ^ bits[a + 1 :]).sum(1, dtype=np.int64)
                meets = (left[a] & right[a + 1 :]) | (right[a] & left[a + 1 :])
                hit = meets & ((100 + percent) * far <= (100 - percent) * (n[a] + n[a + 1 :]))
                hit &= percent * np.maximum(n[a], n[a + 1 :]) <= 100 * np.minimum(n[a], n[a + 1 :])
                out += [(name[root[a]], name[root[b]]) for b in (np.flatnonzero(hit) + a + 1).tolist() if forest.join(root[a], root[b])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.array(out).T], ["a", "b"])

    rows = members.repartition(F.col("g")).sortWithinPartitions("g", "s")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def verified(members: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges between roots by links inside each group of ``(g, left, right, s, root, h)``."""

    def run(batches):
        out: list[tuple[int, int]] = []
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in grouped(batches):
            if t.num_rows < 2:
                continue
            left, right = t.column("left").to_numpy(), t.column("right").to_numpy()
            name, root = np.unique(t.column("root").to_numpy(), return_inverse=True)
            own = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
            size = np.array([len(x) for x in own])
            order = np.argsort(size, kind="stable")
            left, right, size, root, own = left[order], right[order], size[order], root[order], [own[k] for k in order]
            _, flat = np.unique(np.concatenate(own), return_inverse=True)
            flat = flat.reshape(-1)
            start = np.cumsum(size) - size
            forest, mark = Forest(int(root.max()) + 1), np.zeros(int(flat.max()) + 1, np.int32)
            for a in range(len(size) - 1):
                if forest.trees == 1:
                    break
                top = int(np.searchsorted(size, size[a] * 100 // percent, "right"))
                if top <= a + 1:
                    continue
                mine = flat[start[a] : start[a] + size[a]]
                mark[mine] = 1
                end = start[top - 1] + size[top - 1]
                common = np.add.reduceat(mark[flat[start[a + 1] : end]], start[a + 1 : top] - start[a + 1])
                mark[mine] = 0
                meets = (left[a] & right[a + 1 : top]) | (right[a] & left[a + 1 : top])
                hit = meets & (100 * common >= percent * (size[a] + size[a + 1 : top] - common))
                out += [(name[root[a]], name[root[b]]) for b in (np.flatnonzero(hit) + a + 1).tolist() if forest.join(root[a], root[b])]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.array(out).T], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.array(out).T], schema=kind)

    rows = members.repartition(F.col("g")).sortWithinPartitions("g")
    return rows.mapInArrow(lean(run), "a long, b long")


def joined(blocks: DataFrame, key: str, compare, block: int, name: str, once: bool) -> DataFrame:
    """``(node, component)`` of the sets of each key that ``compare`` joins.

    ``blocks`` has ``(key, block, s, pivot)``; ``once`` tells that a set has one key only. At first
    each set goes to one block, that with the smallest pivot, where the pivot goes as well: so
    a group of alike sets sends an edge a set. Only keys of several roots go on then, and of
    their blocks only those of different roots meet."""
    pick = blocks if once else blocks.groupBy("s").agg(F.min(F.struct("pivot", key, "block")).alias("x")).select("s", "x.*")
    pick = pick.where("s <> pivot").select(F.xxhash64(key, "block").alias("g"), key, "s", "pivot")
    groups = pick.drop("pivot").union(pick.select("g", key, F.col("pivot").alias("s")).distinct())
    yes = F.lit(True)
    label = connected(compare(groups.select("g", yes.alias("left"), yes.alias("right"), key, "s", F.col("s").alias("root"))), name)
    hot = written(blocks.groupBy(key).agg((F.max("block") > 0).alias("hot"), F.count(F.lit(1)).alias("n")).where("n > 1 and hot" if once else "n > 1").select(key, "hot"), name)
    if hot.isEmpty():
        return label
    root = label.select(F.col("node").alias("s"), F.col("component").alias("root"))
    rest = blocks.select(key, "s").join(hot, key).join(root, "s", "left")
    rest = written(rest.select(key, "s", "hot", F.coalesce("root", "s").alias("root")), name)
    split = written(rest.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(key), name)
    rest = rest.join(split, key, "left_semi")
    groups = cross_blocks(rest.where("hot").select(key, "s", "root"), key, "s", block)
    if not once:
        groups = groups.union(rest.where("not hot").select(F.xxhash64(key, F.lit("own")), yes, yes, key, "s", "root"))
    more = connected(compare(groups), name)
    tops = more.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = label.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return written(moved.union(more.join(label, "node", "left_anti")), name)


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT, wide: int = SKETCH_SETS, block: int = BLOCK_SETS) -> DataFrame:
    """One row a document: ``key``, ``n_shingles``, ``component_id``."""
    sets = written(sets_of(docs, text, key, k, percent), "sets")
    met = written(runs(chunk_keys(docs, text, k, percent), wide), "runs")
    bits = sets.select("s", "n", F.explode("sketches").alias("x")).select("s", "n", "x.band", "x.bits").dropDuplicates(["s", "band"])

    def by_sketch(groups: DataFrame) -> DataFrame:
        groups = groups.withColumn("band", F.col("run").bitwiseAND(F.lit(int(BAND))))
        return passing(groups.join(bits, ["s", "band"]).select("g", "left", "right", "s", "root", "n", "bits"), percent)

    clusters = joined(met, "run", by_sketch, wide, "clusters", False)
    first = sets.where("n > 0 and doc is not null").groupBy("s").agg(F.min("doc").alias("doc"))
    members = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("s"))

    def hashes(batches):
        for b in batches:
            for at, part in textnum.blocks(b.column("text")):
                h, offs = shingle_sets(part, k)
                blob = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((offs * 8).astype(np.int32).tobytes()), pa.py_buffer(h.tobytes())])
                s = signatures(h, offs)
                same = pa.array(s == b.column("s").slice(at, len(part)).to_numpy())  # of several texts with one doc_id
                yield pa.RecordBatch.from_arrays([pa.array(s), blob], ["s", "h"]).filter(same)

    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    texts = texts.join(members.select("s").join(first, "s"), "doc").mapInArrow(lean(hashes), "s long, h binary")
    shingles = written(texts.dropDuplicates(["s"]), "shingles")  # only of sets in clusters

    def by_set(groups: DataFrame) -> DataFrame:
        return verified(groups.join(shingles, "s").select("g", "left", "right", "s", "root", "h"), percent)

    root = joined(spread(members, block), "cluster", by_set, block, "links", True).select(F.col("node").alias("s"), F.col("component").alias("root"))
    # the smallest document of each set, then of each component; hot sets are minima before they are sent
    least = first.join(root, "s", "left").withColumn("root", F.coalesce("root", "s"))
    least = written(least, "least")
    tops = written(least.groupBy("root").agg(F.min("doc").alias("least")), "least")
    least = written(least.join(tops, "root").select("s", "least"), "least")
    rows = sets.select("doc", "n", "s").join(least, "s", "left")
    component = F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")))
    return rows.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as ws from documents),
g as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') as k from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id as id, doc_id as m from d union select e.b, r.m from r join e on e.a = r.id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.m)::bigint as component_id
from d join r on r.id = d.doc_id left join n on n.doc_id = d.doc_id group by 1, 2
"""

QUERIES = {"op3_jaccard": op3_jaccard}
ORACLES = {"op3_jaccard": ORACLE}
