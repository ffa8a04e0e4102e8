"""Substring deduplication with a compressed FM-index for each shard.

Removed is every word covered by a window of ``WINDOW`` words that also starts earlier
(smaller document, or same document and earlier start).

Windows are dealt to shards by content: a window's anchor is the least hash of the short runs
of words in it, and consecutive windows with one anchor form a fragment. Equal windows have
equal anchors, so all places of a window meet in one shard. Fragments whose anchor occurs once
are done. Equal fragments collapse to their first place, and the others are repeats as a whole.
For the distinct ones left, each shard builds an FM-index over their words (BWT in a wavelet
matrix), searches all their windows backwards, and reports those with an earlier place in
their suffix interval. The windows of an anchor of more than ``HOT`` fragments are not dealt: the
first place of each is aggregated in Spark, and a join with it marks the later ones, so that a
passage in very many documents does not meet in one shard.

Null text: no words. Rows with null doc_id are returned unchanged and repeat nothing. Rows that share
a doc_id are documents of their own, in the order of a hash of their texts (``tag``, 0 for other rows); those
that share the text too are one document. Other columns are kept by ``deduplicated``, but not such as are named
n_words, n_removed, kept or spans, which it makes itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from . import textnum
from .common import lean, written
from .fmindex import FMIndex, Minimum

WINDOW, SEED, HOT, SHARD_WORDS = 20, 6, 1000, 60_000
#: Texts that are taken apart at once.
SLICE = 256


def sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values."""
    size = 1
    while 2 * size <= n:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


def tagged(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with ``__tag``, which tells texts of one id apart, unless they have it."""
    if "__tag" in docs.columns:
        return docs
    again = written(docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__again")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("__again"), "shared-ids")
    if again.isEmpty():
        return docs.withColumn("__tag", F.lit(0).cast("long"))
    tag = F.when(F.col("__again").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))
    return docs.join(again, F.col(key) == F.col("__again"), "left").withColumn("__tag", tag).drop("__again")


def fragments(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``(anchor, content, doc, tag, start, n, inner)``: ``n`` windows from word ``start`` on share an anchor.

    ``inner`` is 1 if a short run comes again so soon that the fragment may repeat inside itself."""

    def run(batches):
        for b in batches:
            for at, part in textnum.blocks(b.column(2)):
                w = textnum.words(part)
                doc = w.doc()
                if len(doc) < window:
                    continue
                short = textnum.runs(w.hash, seed)
                anchor = sliding_least(short, window - seed + 1)
                again = np.zeros(len(short) + 1, np.int64)
                for d in range(1, window - seed + 2):
                    again[1 : len(short) - d + 1] |= short[:-d] == short[d:]
                again = np.cumsum(again)
                ok = doc[: len(anchor)] == doc[window - 1 :]
                new = np.ones(len(anchor) + 1, bool)
                new[1:-1] = (anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1]) | ~ok[:-1]
                edge = np.flatnonzero(new)
                first, n = edge[:-1], np.diff(edge)
                some = ok[first]
                first, n = first[some], n[some]
                # a window is valid up to the last whole one of its document
                n = np.minimum(n, w.offsets[doc[first] + 1] - window + 1 - first)
                content = textnum.hashes_of(w.hash, first, first + n + window - 1)
                ids, tags = (b.column(k).slice(at, len(part)).to_numpy(zero_copy_only=False) for k in (0, 1))
                inner = again[np.minimum(first + n + window - seed, len(again) - 1)] > again[first]
                cols = anchor[first].view(np.int64), content.view(np.int64), ids[doc[first]], tags[doc[first]], first - w.offsets[doc[first]], n, inner.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "content", "doc", "tag", "start", "n", "inner"])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col("__tag").alias("tag"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), "anchor long, content long, doc long, tag long, start long, n long, inner long")


def extracted(docs: DataFrame, wanted: DataFrame, text: str, key: str, window: int, hot: int) -> DataFrame:
    """The word hashes of ``wanted(doc, tag, anchor, start, n, rows)``; hot anchors give the hash of each window and no words."""
    need = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "start", "n", "rows")).alias("need"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col("__tag").alias("tag"), F.col(text).alias("text")).join(need, ["doc", "tag"])

    def run(batches):
        for b in batches:
            for at, part in textnum.blocks(b.column("text")):
                w = textnum.words(part)
                own = b.column("need").slice(at, len(part))
                flat = own.flatten()
                which = np.repeat(np.arange(len(part)), np.diff(own.offsets.to_numpy()))
                anchor, start, n, rows = (flat.field(k).to_numpy() for k in range(4))
                ids, tags = (b.column(c).slice(at, len(part)).to_numpy()[which] for c in ("doc", "tag"))
                first = w.offsets[which] + start
                fits = first + n + window - 1 <= w.offsets[which + 1]
                anchor, start, n, rows, ids, tags, first = (x[fits] for x in (anchor, start, n, rows, ids, tags, first))
                is_hot = rows > hot
                if is_hot.any():
                    m = np.where(is_hot, n, 1)
                    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    anchor, start, n, ids, tags, first, is_hot = (np.repeat(x, m) for x in (anchor, start, n, ids, tags, first, is_hot))
                    first, start, n = first + step, start + step, np.where(is_hot, 1, n)
                    own_hash = textnum.hashes_of(w.hash, first, first + window)
                    anchor = np.where(is_hot, own_hash.view(np.int64), anchor)
                size = np.where(is_hot, 0, n + window - 1)
                hashes = textnum.gather(w.hash, first, size)
                offsets = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids), pa.array(tags), pa.array(start), blob, pa.array(is_hot)], ["anchor", "doc", "tag", "start", "words", "hot"])

    return rows.mapInArrow(lean(run), "anchor long, doc long, tag long, start long, words binary, hot boolean")


def later_windows(rows: DataFrame, window: int) -> DataFrame:
    """``(doc, tag, a, b)`` of the windows ``(anchor, doc, tag, start)`` that come earlier too; ``anchor`` is a window's hash."""
    first = rows.groupBy("anchor").agg(F.min(F.struct("doc", "tag", "start")).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    again = rows.join(first, "anchor").where(F.struct("doc", "tag", "start") > F.col("first"))
    return again.select("doc", "tag", F.col("start").alias("a"), (F.col("start") + window).alias("b"))


def search_shard(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, words: list[bytes], window: int):
    """``(doc, tag, from, to)`` of the windows of a shard's fragments with an earlier place in the shard."""
    size = np.array([len(x) // 8 for x in words])
    flat = np.frombuffer(b"".join(words), np.uint64)
    _, symbol = np.unique(flat, return_inverse=True)
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    seq = np.zeros(ends[-1], np.int32)
    keep = np.ones(len(seq), bool)
    keep[ends - 1] = False
    seq[keep] = symbol.reshape(-1) + 1
    index = FMIndex(seq, window)
    n = size - window + 1
    which = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = begin[which] + offset
    low, high = index.search(seq, first, window)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return None
    # the order of places: document, then word
    at = start[which] + offset
    _, place = np.unique(np.stack([doc[which], tag[which], at], 1), axis=0, return_inverse=True)
    place = place.reshape(-1)
    order = np.full(len(seq), len(which), np.int64)
    order[first] = place
    least = Minimum(order[index.sa], int((high - low).max())).of(low[hit], high[hit])
    hit = hit[least < place[hit]]
    return doc[which[hit]], tag[which[hit]], at[hit], at[hit] + window


def searched(rows: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Runs the shards: whole anchors of a sorted partition, about ``shard_words`` words each."""

    def merged(doc, tag, a, b):
        """Covered ranges of a shard's windows, joined where they overlap."""
        order = np.lexsort([a, tag, doc])
        doc, tag, a, b = doc[order], tag[order], a[order], b[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (a[1:] > b[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[new], tag[new], a[new], b[last])], ["doc", "tag", "a", "b"])

    def run(batches):
        held, count = [], 0
        for b in (*batches, None):
            if b is not None and b.num_rows:
                held.append(b)
                count += sum(map(len, b.column("words").to_pylist())) // 8
            if not held or (b is not None and count < shard_words):
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = len(anchor) if b is None else int(np.searchsorted(anchor, anchor[-1]))
            doc, tag, start = (table.column(c).to_numpy()[:cut] for c in ("doc", "tag", "start"))
            words = table.column("words").to_pylist()[:cut]
            groups = np.flatnonzero(np.append(True, anchor[1:cut] != anchor[: cut - 1])) if cut else np.zeros(0, int)
            ends = np.append(groups[1:], cut)
            size = np.concatenate([[0], np.cumsum([len(x) // 8 for x in words])])
            s = 0
            while s < len(groups):
                e = max(s + 1, int(np.searchsorted(size[ends], size[groups[s]] + shard_words, "right")))
                x, y = groups[s], ends[e - 1]
                s = e
                if got := search_shard(doc[x:y], tag[x:y], start[x:y], words[x:y], window) if size[y] - size[x] > window else None:
                    yield merged(*got)
            rest = table.slice(cut)
            held = rest.combine_chunks().to_batches() if rest.num_rows else []
            count = sum(len(x) // 8 for x in rest.column("words").to_pylist()) if rest.num_rows else 0

    rows = rows.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return rows.mapInArrow(lean(run), "doc long, tag long, a long, b long")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, seed: int = SEED, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc, tag, spans)``: ranges of words [a, b) to remove, for documents that have any."""
    docs = tagged(docs, text, key)
    found = fragments(docs, text, key, window, seed)
    counts = F.count(F.lit(1)).alias("rows"), F.max("inner").alias("inner")
    often = found.groupBy("anchor").agg(*counts).where("rows > 1 or inner = 1").select("anchor")
    some = written(found.join(often, "anchor"), "fragments")
    own = some.groupBy("anchor", "content").agg(F.min(F.struct("doc", "tag", "start")).alias("first"), F.max("n").alias("n"), F.max("inner").alias("inner"))
    own = written(own, "distinct-fragments")
    later = some.join(own.select("anchor", "content", "first"), ["anchor", "content"]).where(F.struct("doc", "tag", "start") > F.col("first"))
    later = later.select("doc", "tag", F.col("start").alias("a"), (F.col("start") + F.col("n") + window - 1).alias("b"))
    many = own.groupBy("anchor").agg(*counts).where("rows > 1 or inner = 1").select("anchor", "rows")
    wanted = own.join(many, "anchor").select("anchor", "first.doc", "first.tag", "first.start", "n", "rows")
    parts = extracted(docs, wanted, text, key, window, hot)
    inside = searched(parts.where("not hot").drop("hot"), window, shard_words)
    if not many.where(F.col("rows") > hot).isEmpty():
        # in one plan, so that the texts are shuffled once for all branches
        inside = inside.union(later_windows(parts.where("hot").select("anchor", "doc", "tag", "start"), window))
    return later.union(inside).groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def removed(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and the kept words joined by a space (``kept``), or their SHA-256."""
    out = "kept_sha256" if digest else "kept"
    docs = tagged(docs.drop("n_words", "n_removed", out, "spans", "__doc"), text, key)
    rows = docs.join(spans.select(F.col("doc").alias("__doc"), F.col("tag").alias("__own"), "spans"), (F.col(key) == F.col("__doc")) & (F.col("__tag") == F.col("__own")), "left").drop("__doc", "__own", "__tag")
    docs = docs.drop("__tag")
    names = docs.columns

    def run(batches):
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            total, gone, kept = [], [], []
            for t, own in zip(b.column(names.index(text)).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                words = (t or "").encode().split()
                n = len(words)
                if own:
                    off = np.zeros(n + 1, np.int64)
                    for s in own:
                        off[min(s["a"], n)] += 1
                        off[min(s["b"], n)] -= 1
                    words = [w for w, x in zip(words, np.cumsum(off).tolist(), strict=False) if not x]
                total.append(n)
                gone.append(n - len(words))
                whole = b" ".join(words)
                kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
            cols = [*b.columns[: len(names)], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_words", "n_removed", out])

    schema = StructType(list(docs.schema.fields)).add("n_words", LongType()).add("n_removed", LongType()).add(out, StringType())
    return rows.select(*names, "spans").mapInArrow(lean(run), schema)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeats removed from ``text``; documents without any keep theirs as it is."""
    docs = tagged(docs, text, key)
    rows = removed(docs, repeats(docs, text, key), text, key)
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text))
    return rows.withColumn(text, new).drop("n_words", "kept")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = tagged(docs, "text", "doc_id")
    return removed(docs, repeats(docs), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from g) where r > 1),
gone as (select doc_id, count(distinct p) as n, list(distinct p) as ps from (select doc_id, unnest(range(i, i + 20)) as p from later) group by doc_id),
kept as (select w.doc_id, string_agg(ws[p], ' ' order by p) as t from w, unnest(range(1, len(ws) + 1)) as u(p)
         where not exists (select 1 from later l where l.doc_id = w.doc_id and l.i between p - 19 and p) group by w.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(gone.n, 0)::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join gone using (doc_id) left join kept using (doc_id)
"""

QUERIES = {"op6_substring": op6_substring}
ORACLES = {"op6_substring": ORACLE}
