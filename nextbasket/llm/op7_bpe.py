"""BPE encoding and decoding through one table of distinct words.

Texts are split into words in blocks of about ``BLOCK`` bytes. A block lists its distinct words,
most frequent first, and has the number in that list for each place of a word. The table of
distinct words is dealt by word hash to buckets: every block sends each bucket its share of the
list, a word of the corpus is encoded once in its bucket, and the ids go back to the blocks
that listed it, where they are joined by place. Decoding joins the ids with the tokenizer's
id-to-piece table, whose size is fixed. What is shuffled is packed lists and numbers, not a row
for each place. Pieces never span white space, so the ids of a text are those of its words in
order; marks at the end of a word are words of their own.

The texts are read twice, so they must be the same both times, as those of a table are; if a
block differs, the job fails and no row is lost. Null text: empty, no tokens. Other columns are
ignored, repeated rows (also of one id) each get their own result, an empty table gives no
rows. Strings of special tokens in a text are encoded as the library does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, textnum
from .common import grouped, lean

#: Bytes of text in a block (a longer text is a block of its own), and those split at once.
BLOCK, PART = 24_000_000, 3_000_000
#: Least and most buckets of the word table, and texts for each bucket in between.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_DOCS = 64, 16_384, 4096
#: Bytes of listed words that a bucket looks up at once.
LOOKUP = 2_000_000


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Listed:
    """Distinct words of a block of texts, most frequent first, and their numbers at each place."""

    def __init__(self, keys: pa.Array, texts: pa.Array):
        found, self.ends, at = [], [], 0
        name = hashlib.blake2b(str(keys.to_pylist()).encode(), digest_size=8)
        for _, part in textnum.blocks(texts, PART):
            data, first, last, key, plain, number, before = bpe.entries(part)
            name.update(data[len(data) // 2 :])
            name.update(np.diff(before).tobytes())
            found.append((key, textnum.gather(data, first, last - first), last - first, plain, number))
            self.ends.append(before[1:] + at)
            at += len(number)
        key, flat, size, plain = (np.concatenate([f[k] for f in found]) for k in range(4))
        base = np.cumsum([0, *(len(f[0]) for f in found)])
        _, once, which = np.unique(key, return_index=True, return_inverse=True)
        number = np.concatenate([which.reshape(-1)[b : b + len(f[0])][f[4]] for b, f in zip(base.tolist(), found, strict=False)])
        order = np.argsort(-np.bincount(number, minlength=len(once)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.places, self.ends = rank[number], np.concatenate(self.ends)
        once = once[order]
        self.key, self.plain, self.flat, self.start, self.size = key[once], plain[once], flat, (np.cumsum(size) - size)[once], size[once]
        self.name = int.from_bytes(name.digest(), "little", signed=True)

    def shares(self, buckets: int):
        """``(bucket, n, words, plain, ranks)``: words end in a line feed."""
        bucket = (self.key >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        size = self.size[order]
        text = np.full(int(size.sum()) + len(size), 10, np.uint8)
        text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = textnum.gather(self.flat, self.start[order], size)
        ends = np.cumsum(size + 1)
        edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else order
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=False):
            own = text[ends[s - 1] if s else 0 : ends[e - 1]]
            ranks = np.diff(order[s:e], prepend=0)
            yield int(bucket[order[s]]), e - s, pa.compress(own.tobytes(), codec="zstd", asbytes=True), len(own), np.packbits(self.plain[order[s:e]]).tobytes(), packed(ranks)


def listed(batches):
    """``(keys, Listed)`` of each block of rows ``(key, text)``."""
    for b in batches:
        for at, part in textnum.blocks(b.column(1), BLOCK):
            keys = b.column(0).slice(at, len(part))
            yield keys, Listed(keys, part)


def shares_of(rows: DataFrame, buckets: int) -> DataFrame:
    """What each block lists for each bucket of the word table."""

    def run(batches):
        for _, block in listed(batches):
            out = [(block.name, *share) for share in block.shares(buckets)]
            if out:
                types = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], ["block", "bucket", "n", "words", "bytes", "plain", "ranks"])

    return rows.mapInArrow(lean(run), "block long, bucket int, n int, words binary, bytes int, plain binary, ranks binary")


def encoded(shares: DataFrame, path: str | None) -> DataFrame:
    """The shares with ``ids`` and their ``sizes`` in place of the words: each word of a bucket is encoded once."""
    shared = shares.sparkSession.sparkContext.broadcast(bpe.source(path))

    def run(batches):
        encoder = bpe.Encoder(shared.value)

        def found(rows):
            texts = [pa.decompress(w, n, codec="zstd", asbytes=True) for w, n in zip(rows.column("words").to_pylist(), rows.column("bytes").to_pylist(), strict=True)]
            data, count = np.frombuffer(b"".join(texts), np.uint8), rows.column("n").to_numpy()
            last = np.flatnonzero(data == 10)
            first = np.concatenate([[0], last[:-1] + 1])
            plain = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool) for p, n in zip(rows.column("plain").to_pylist(), count.tolist(), strict=True)])
            start, size = encoder.lookup(data, first, last, plain)
            at = np.concatenate([[0], np.cumsum(count)])
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield packed(textnum.gather(encoder.pool, start[s:e], size[s:e])), packed(size[s:e]), int(size[s:e].sum())

        for b in batches:
            at, ends = 0, np.cumsum(b.column("bytes").to_numpy())
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKUP, "right")))
                rows = b.slice(at, to - at)
                if len(encoder.keys) > bpe.WORDS:
                    encoder.clear()
                ids, sizes, total = zip(*found(rows), strict=True)
                yield pa.RecordBatch.from_arrays([rows.column("block"), rows.column("bucket"), rows.column("n"), rows.column("ranks"), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary()), pa.array(total, pa.int32())], ["block", "bucket", "n", "ranks", "ids", "sizes", "total"])
                at = to

    return shares.repartition(F.col("bucket")).mapInArrow(lean(run), "block long, bucket int, n int, ranks binary, ids binary, sizes binary, total int")


def placed_of(rows: DataFrame, kind: str) -> DataFrame:
    """``(block, n, keys, ends, places)`` of each block."""

    def run(batches):
        for keys, block in listed(batches):
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([block.name]), pa.array([len(block.key)], pa.int32()), one(keys), one(pa.array(block.ends, pa.int64())), pa.array([packed(block.places)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "n", "keys", "ends", "places"])

    return rows.mapInArrow(lean(run), f"block long, n int, keys array<{kind}>, ends array<long>, places binary")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row a document: ``key``, ``n_tokens``, ``ids`` and the ``decoded`` text, or SHA-256 of both."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, docs.count() // BUCKET_DOCS))
    own = encoded(shares_of(rows, buckets), path).withColumn("part", F.lit(1))
    main = placed_of(rows, kind).withColumn("part", F.lit(0))
    both = main.unionByName(own, allowMissingColumns=True).select("block", "part", "bucket", "n", "keys", "ends", "places", "ranks", "ids", "sizes", "total")
    both = both.repartition(F.col("block")).sortWithinPartitions("block", "part", "bucket")
    pieces = docs.sparkSession.sparkContext.broadcast(bpe.Encoder(bpe.source(path)).pieces())

    def run(batches):
        for t in grouped(batches, "block"):
            part = t.column("part").to_numpy()
            mine, lists = t.slice(0, int((part == 0).sum())), t.slice(int((part == 0).sum())).to_pylist()
            lists = list({r["bucket"]: r for r in lists}.values())  # equal blocks list the same
            n = sum(r["n"] for r in lists)
            if not mine.num_rows or mine.column("n")[0].as_py() != n:
                raise ValueError("texts changed between two reads: write them to a table first")
            order = np.concatenate([np.cumsum(unpacked(r["ranks"], r["n"])) for r in lists]) if lists else np.zeros(0, np.int64)
            flat = np.concatenate([unpacked(r["ids"], r["total"]) for r in lists]) if lists else np.zeros(0, "<u4")
            size = np.concatenate([unpacked(r["sizes"], r["n"]) for r in lists]).astype(np.int64) if lists else np.zeros(0, np.int64)
            del lists
            to = np.argsort(order, kind="stable")
            start, size = (np.cumsum(size) - size)[to], size[to]
            flat, start = textnum.gather(flat, start, size), np.cumsum(size) - size
            own = [flat[s : s + k].tolist() for s, k in zip(start.tolist(), size.tolist(), strict=True)]
            piece = pieces.value
            texts = [" ".join([piece[i] for i in x]) for x in own]
            digits = [" ".join(map(str, x)) for x in own] if digests else []
            del own
            for row in range(mine.num_rows):
                keys, ends = mine.column("keys").combine_chunks()[row].values, mine.column("ends").combine_chunks()[row].values.to_numpy()
                places = unpacked(mine.column("places")[row].as_py(), int(ends[-1]) if len(ends) else 0)
                for a in range(0, len(ends), 1024):
                    cols: list[list] = [[], [], []]
                    for s, e in zip([int(ends[a - 1]) if a else 0, *ends[a : a + 1023].tolist()], ends[a : a + 1024].tolist(), strict=False):
                        at = places[s:e]
                        some = [k for k in at.tolist() if size[k]]
                        cols[0].append(int(size[at].sum()))
                        cols[1].append(hashlib.sha256(" ".join([digits[k] for k in some]).encode()).hexdigest() if digests else textnum.gather(flat, start[at], size[at]))
                        out = " ".join([texts[k] for k in some])
                        cols[2].append(hashlib.sha256(out.encode()).hexdigest() if digests else out)
                    types = pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string()
                    yield pa.RecordBatch.from_arrays([keys.slice(a, len(cols[0])), *map(pa.array, cols, types)], ["key", "n", "ids", "decoded"])

    out = both.mapInArrow(lean(run), f"key {kind}, n long, ids {'string' if digests else 'array<int>'}, decoded string")
    end = "_sha256" if digests else ""
    return out.toDF(key, "n_tokens", f"ids{end}", f"decoded{end}")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
