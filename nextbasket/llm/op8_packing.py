"""Packing of token ids into sequences by first-fit decreasing.

A document is cut into full sequences and a rest shorter than one. Documents fall into
randomised groups of about ``GROUP_DOCS``; each group packs its rests on its own by
first-fit decreasing, and a tournament tree over the free space of its bins finds the first
that fits. The emptiest bins are then cut up to fill the gaps of the others, so that a group
pads one sequence at most.

Null text: empty, just the end id. Repeated rows are packed each for itself. Other columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import lean

LENGTH, END_ID, GROUP_DOCS = 2048, 1, 1024
PIECE = "key long, start long, length long, crc long, doc_tokens long, ids binary, doc_crc long"


class Tournament:
    """Free space of bins; finds the first bin with room in logarithmic time."""

    def __init__(self, bins: int, space: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.best = [space] * (2 * self.size)

    def take(self, need: int) -> int:
        k = 1
        while k < self.size:
            k = 2 * k if self.best[2 * k] >= need else 2 * k + 1
        at = k - self.size
        self.best[k] -= need
        while k > 1:
            k //= 2
            self.best[k] = max(self.best[2 * k], self.best[2 * k + 1])
        return at


def first_fit_decreasing(sizes: list[int], space: int) -> list[list[int]]:
    """Bins of item numbers."""
    tree = Tournament(max(1, len(sizes)), space)
    bins: dict[int, list[int]] = {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        bins.setdefault(tree.take(sizes[k]), []).append(k)
    return [bins[b] for b in sorted(bins)]


def filled(bins: list[list[int]], sizes: list[int], space: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, length): the emptiest bins are cut into the gaps of the fullest."""
    rows = [[(k, 0, sizes[k]) for k in b] for b in bins]
    load = [sum(x[2] for x in b) for b in rows]
    order = sorted(range(len(rows)), key=lambda b: (-load[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        to, out = order[low], order[high]
        gap = space - load[to]
        if not gap:
            low += 1
        elif not rows[out]:
            high -= 1
        else:
            k, start, n = rows[out].pop()
            take = min(gap, n)
            rows[to].append((k, start, take))
            load[to] += take
            load[out] -= take
            if take < n:
                rows[out].append((k, start + take, n - take))
    return [r for r in rows if r]


def width(source: str, end_id: int = END_ID) -> str:
    """The smallest type that holds every id of a tokenizer."""
    return "<u2" if max(*json.loads(source)["model"]["vocab"].values(), end_id) < 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each full sequence of a document, and one with the ids of its rest."""
    source = bpe.source(path)
    shared, kind = docs.sparkSession.sparkContext.broadcast(source), width(source, end_id)

    def run(batches):
        encoder = bpe.Encoder(shared.value)
        for b in batches:
            for at, ids, offs in encoder.encode(b.column(1)):
                rows = []
                for doc, s, e in zip(b.column(0).slice(at, len(offs) - 1).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    own = np.append(ids[s:e], end_id).astype("<u4")
                    whole = zlib.crc32(own)
                    for k in range(0, len(own), length):
                        part = own[k : k + length]
                        rest = part.astype(kind).tobytes() if len(part) < length else None
                        rows.append((doc, k, len(part), zlib.crc32(part), len(own), rest, whole))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 5, pa.binary(), pa.int64()), strict=True)], [x.split()[0] for x in PIECE.split(", ")])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(lean(run), PIECE)


def pack(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    kind = width(bpe.source(path), end_id)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "start"], kind="stable")
        group = int(pdf["grp"].iloc[0])
        seq, out = group << 32, []
        whole = pdf["ids"].isna()
        for r in pdf[whole].itertuples():
            out.append((r.key, r.start, r.length, r.crc, r.doc_tokens, seq, 0))
            seq += 1
        rest = pdf[~whole]
        sizes = rest["length"].tolist()
        keys, starts, ids, tokens = rest["key"].tolist(), rest["start"].tolist(), rest["ids"].tolist(), rest["doc_tokens"].tolist()
        for b in filled(first_fit_decreasing(sizes, length), sizes, length):
            at = 0
            for k, s, n in b:
                crc = zlib.crc32(np.frombuffer(ids[k], kind)[s : s + n].astype("<u4").tobytes())
                out.append((keys[k], starts[k] + s, n, crc, tokens[k], seq, at))
                at += n
            seq += 1
        return pd.DataFrame(out, columns=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({key: "Int64"})

    rows = tokenized(docs, path, text, key, length, end_id)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("key", "doc_tokens", "doc_crc"), F.lit(groups)))
    return rows.groupBy("grp").applyInPandas(one, f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
