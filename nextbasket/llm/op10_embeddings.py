"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to ``BLOCKS`` blocks of eight dimensions by random orthonormal
matrices, one for each of ``TABLES`` tables, and every block is decoded to the nearest point of
the E8 lattice. A vector enters its own cell and the neighbouring one in the other coset of D8,
for each block. Vectors of one label that share a cell are compared by cosine in double
precision. A pair that shares several cells counts in the least of them.

Equal vectors collapse to one with its number of copies. Cells of more than ``BLOCK_ROWS``
vectors are split into pairs of blocks. Every row is indexed and queried.

Vectors that are null, zero, or hold null or non-finite components, and rows with null label
or vec_id, link with nothing; they are their own component. Vectors of different length are
never compared. Other columns are ignored, repeated rows are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, block_pairs, connected, grouped, lean, written

COSINE, TABLES, BLOCKS, SCALE, BLOCK_ROWS = 0.98, 3, 2, 0.35, 256


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.arange(len(x))
    odd = near.sum(1) % 2 != 0
    near[rows[odd], worst[odd]] += np.where(off[rows[odd], worst[odd]] >= 0, 1, -1)
    return near


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest E8 point, and twice the nearest point of the other coset."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    swap = (((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1))[:, None]
    return (2 * np.where(swap, b, a)).astype(np.int64), (2 * np.where(swap, a, b)).astype(np.int64)


def codes(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE) -> np.ndarray:
    """Keys of the cells that each vector enters: ``[row, table x 2 ** blocks]``."""
    out = []
    for t in range(tables):
        axes = np.random.default_rng([t, unit.shape[1]]).standard_normal((unit.shape[1], 8 * blocks))
        if unit.shape[1] >= 8 * blocks:
            axes = np.linalg.qr(axes)[0]
        y = unit @ axes / scale
        both = [cells(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        for pick in range(2**blocks):
            h = np.full(len(unit), t + 1, np.uint64)
            for b in range(blocks):
                for c in both[b][pick >> b & 1].T:
                    h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
            out.append(h.view(np.int64))
    return np.stack(out, 1)


def links(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row a vector: ``key``, ``n_links``, ``component_id``."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    fine = fine & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (size > 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.where("fine").groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))

    def code(batches):
        for b in batches:
            lists = b.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                own = codes(x)
                some = b.take(pa.array(at))
                unit = pa.array([r.tobytes() for r in x], pa.binary())
                key = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("copies"), some.column("label").cast(pa.string()), unit, key], ["node", "copies", "label", "unit", "codes"])

    nodes = written(good.mapInArrow(lean(code), "node long, copies long, label string, unit binary, codes array<long>"), "vectors")
    places = nodes.select("node", F.explode(F.array_distinct("codes")).alias("code"), "label", F.length("unit").alias("dim"))
    places = places.select("node", "code", F.xxhash64("code", "label", "dim").alias("cell"))

    def compare(batches):
        for t in grouped(batches):
            n = t.num_rows
            if n < 2:
                continue
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(n, -1)
            own = t.column("codes").combine_chunks().flatten().to_numpy().reshape(n, -1)
            code, left, right = t.column("code")[0].as_py(), t.column("left").to_numpy(), t.column("right").to_numpy()
            a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
            a, b = (k[(left[a] & right[b]) | (right[a] & left[b])] for k in (a, b))
            first = np.ones(len(a), bool)
            for s in range(0, len(a), 20_000):
                u, v = own[a[s : s + 20_000]], own[b[s : s + 20_000]]
                shared = (u[:, :, None] == v[:, None, :]).any(2)
                first[s : s + 20_000] = np.where(shared, u, np.iinfo(np.int64).max).min(1) == code
            a, b = a[first], b[first]
            if not len(a):
                continue
            count = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            forest = Forest(n)
            tree = [(int(node[i]), int(node[j])) for i, j in zip(a.tolist(), b.tolist(), strict=True) if forest.join(i, j)]
            at = np.flatnonzero(count)
            cols = np.concatenate([node[at], [e[0] for e in tree]]), np.concatenate([np.zeros(len(at)), [1] * len(tree)]), np.concatenate([count[at], [e[1] for e in tree]])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["a", "edge", "b"])

    groups = block_pairs(places, "cell", "node", BLOCK_ROWS)
    # the code goes along: it tells in which cell a pair counts
    groups = groups.join(places, ["cell", "node"]).select("g", "left", "right", "node", "code")
    groups = groups.join(nodes, "node").repartition(F.col("g")).sortWithinPartitions("g")
    found = written(groups.mapInArrow(lean(compare), "a long, edge long, b long"), "links")
    roots = connected(found.where("edge = 1").select("a", "b"), "vector-links")
    counts = found.where("edge = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    done = nodes.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    done = done.select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    own = rows.where("fine").join(good.select("label", "v", "node"), ["label", "v"]).join(done, "node").select("id", "n_links", "root")
    rest = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))
    return own.union(rest).select(F.col("id").alias(key), "n_links", F.col("root").alias("component_id"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, e from v where list_dot_product(e, e) > 0),
e as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as id, vec_id as m from embeddings union select e.b, r.m from r join e on e.a = r.id),
c as (select id, min(m) as m from r group by id)
select x.vec_id, (select count(*) from e where e.a = x.vec_id)::bigint as n_links, c.m::bigint as component_id, x.vec_id = c.m as kept
from embeddings x join c on c.id = x.vec_id
"""

QUERIES = {"op10_embeddings": op10_embeddings}
ORACLES = {"op10_embeddings": ORACLE}
