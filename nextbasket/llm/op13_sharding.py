"""Sharding by a k-d tree over metadata, with shards of nearly equal bytes.

Points are the distinct texts, so that copies share a shard; a point weighs the bytes of all its copies.
From the root on, each node is split along its widest dimension (spread of the metadata in the node, scaled by
that of the table) at the weighted median, or the quantile that fits the space in the leaves below it. A median is
found exactly, without sorting: sums of weights by the first bits of the coordinate, then by the next bits in the
bucket that holds it, and so on, for all nodes of a level in the same jobs. Equal coordinates are told apart by a hash.

A text whose copies weigh more than 1 / ``FINE`` of a shard is heavy. There are at most shards * ``FINE`` such
texts; they are laid largest first on the emptiest shard, and the tree fills the space left. So no split is coarse, and
no join meets a heavy key. A text that weighs more than a whole shard cannot stay together: its rows are dealt by a hash
of the id to parts, each of which is a heavy text of its own.

Everything is columns of Spark: no Python in the tasks. The driver sees the heavy texts and one row a node.

Null text: size 1, as an empty one. Null ids, repeated rows and ties are rows like all others. Null
metadata: the least value. Other columns are ignored, also such as have names of the result. Empty table: no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARDS, FINE = 8, 512
#: Bits of a coordinate (scaled metadata, then a hash), and of one round of the search for a median.
VALUE_BITS, HASH_BITS, ROUND_BITS = 30, 30, 12


def nominal(c: Column) -> Column:
    """A place between 0 and 1 for a value without order."""
    return F.crc32(c.cast("string").cast("binary")) / F.lit(float(1 << 32))


def metadata(lang: str = "lang", source: str = "source") -> dict[str, Column]:
    """Dimensions of ``documents``: size of the text, language and source."""
    return {"d_size": F.log2(F.col("size").cast("double")), "d_lang": nominal(F.col(lang)), "d_source": nominal(F.col(source))}


def laid(weights: list[int], shards: int) -> tuple[list[int], list[int]]:
    """Shard of each weight, largest first on the emptiest, and the loads."""
    heap, loads, out = [(0, s) for s in range(shards)], [0] * shards, [0] * len(weights)
    for k in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        load, s = heapq.heappop(heap)
        out[k], loads[s] = s, load + weights[k]
        heapq.heappush(heap, (loads[s], s))
    return out, loads


def space(loads: list[int], more: int) -> list[float]:
    """What each shard takes of ``more``, so that the loads become as equal as they can."""
    level, left = 0.0, sorted(loads)
    for k in range(len(left), 0, -1):
        level = (more + sum(left[:k])) / k
        if level >= left[k - 1]:
            break
    return [max(0.0, level - x) for x in loads]


def coordinate(dims: list[str], which: Column) -> Column:
    """The coordinate of a point along the dimension with the number ``which``: a long, distinct for almost all points."""
    value = F.array(*[F.col(d) for d in dims])[which]
    return F.shiftleft(value, HASH_BITS).bitwiseOR(F.shiftright(F.xxhash64("text_key", "part"), 64 - HASH_BITS).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def split_at(points: DataFrame, nodes: dict[int, tuple[int, float]], dims: list[str]) -> dict[int, int]:
    """For each node with its dimension and the weight that goes left: the coordinate below which points go left."""
    spark, bits = points.sparkSession, VALUE_BITS + HASH_BITS
    found = {n: (0, want) for n, (_, want) in nodes.items()}
    shift = bits
    while shift > 0:
        step = min(ROUND_BITS, shift)
        shift -= step
        # a row a node
        at = spark.createDataFrame([(n, nodes[n][0], prefix, float(want)) for n, (prefix, want) in found.items()], "node int, dim int, prefix long, want double")
        rows = points.join(F.broadcast(at), "node").withColumn("c", F.shiftright(coordinate(dims, F.col("dim")), shift))
        sums = rows.where(F.shiftright("c", step) == F.col("prefix")).groupBy("node", "want", "c").agg(F.sum("weight").alias("w"))
        run = F.sum("w").over(W.partitionBy("node").orderBy("c").rowsBetween(W.unboundedPreceding, 0))
        # the last bucket that begins at or below the weight wanted; a node has 2 ** ROUND_BITS buckets at most
        held = sums.withColumn("before", run - F.col("w")).where("before <= want").groupBy("node").agg(F.max_by(F.struct("c", "before", "w"), "c").alias("z"))
        for r in held.collect():
            want = found[r.node][1]
            c, rest = r.z.c, want - r.z.before
            if shift == 0 and 2 * rest > r.z.w:
                c += 1  # the point nearer to the left goes there
            found[r.node] = c, rest
    return {n: c for n, (c, _) in found.items()}


def tree(points: DataFrame, takes: list[float], dims: list[str]) -> DataFrame:
    """``points`` with ``shard``; ``takes`` are the weights that the leaves have space for."""
    ranges = {0: (0, len(takes))}  # node: its leaves
    points = points.withColumn("node", F.lit(0))
    spark = points.sparkSession
    while any(b - a > 1 for a, b in ranges.values()):
        open_nodes = {n: r for n, r in ranges.items() if r[1] - r[0] > 1}
        spread = points.groupBy("node").agg(F.sum("weight").alias("weight"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()  # a row a node
        own = {r.node: r for r in spread}
        todo = {}
        for n, (a, b) in open_nodes.items():
            if n in own:
                whole, low = sum(takes[a:b]), sum(takes[a : (a + b) // 2])
                widest = max(range(len(dims)), key=lambda d: (own[n][dims[d]], -d))  # noqa: B023
                todo[n] = widest, own[n].weight * low / whole if whole else 0.0
        cuts = split_at(points, todo, dims)
        ranges = {m: r for n, (a, b) in ranges.items() for m, r in (((2 * n + 1, (a, (a + b) // 2)), (2 * n + 2, ((a + b) // 2, b))) if b - a > 1 else ((n, (a, b)),))}
        if todo:
            at = spark.createDataFrame([(n, todo[n][0], c) for n, c in cuts.items()], "node int, dim int, cut long")
            moved = points.join(F.broadcast(at), "node", "left")
            below = F.when(coordinate(dims, F.col("dim")) < F.col("cut"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
            points = written(moved.withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(below).cast("int")).drop("dim", "cut"), "nodes")
    at = spark.createDataFrame([(n, a) for n, (a, _) in ranges.items()], "node int, shard int")
    return points.join(F.broadcast(at), "node").drop("node")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: 0, 1, .. in each shard, from the counts of the partitions before. No shard meets in one task."""
    rows = rows.sortWithinPartitions("shard").withColumn("m", F.monotonically_increasing_id())
    # written once: a second run could be dealt to other partitions
    rows = written(rows.withColumns({"p": F.shiftright("m", 33), "k": F.col("m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("m"), "dealt")
    runs = rows.groupBy("p", "shard").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("p", "shard", (before - F.col("first")).alias("add"))
    return rows.join(runs, ["p", "shard"]).withColumn("slot", F.col("k") + F.col("add")).drop("p", "k", "add")


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dims: dict[str, Column] | None = None, text: str = "text", key: str = "doc_id", fine: int = FINE) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``dims`` are numeric columns of ``docs`` (``size`` is one of them); ``target_bytes`` gives the number of shards instead of ``shards``."""
    dims = metadata() if dims is None else dims
    raw = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(raw) + 1).cast("long")
    named = docs.withColumn("size", size).select(
        F.col(key).alias("key"), "size", F.crc32(raw.cast("binary")).alias("crc"), F.unhex(F.md5(raw.cast("binary"))).alias("text_key"), *[v.cast("double").alias(n) for n, v in dims.items()]
    )
    rows = written(named, "sizes")
    total = rows.agg(F.sum("size").alias("t")).first().t or 0
    if target_bytes is not None:
        shards = max(1, -(-total // target_bytes))
    whole = max(1, total // shards)
    texts = written(rows.groupBy("text_key").agg(F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in dims]), "texts")
    # texts above a shard, at most as many as shards: dealt to parts that are heavy, but fine
    over = {bytes(r.text_key): -(-r.weight * 16 // whole) for r in texts.where(F.col("weight") > whole).select("text_key", "weight").collect()}
    part = F.lit(0).cast("long")
    for k, n in over.items():
        part = F.when(F.col("text_key") == F.lit(bytearray(k)), F.pmod(F.xxhash64("key", F.lit(5)), F.lit(n))).otherwise(part)
    rows = rows.withColumn("part", part)
    if over:
        texts = written(rows.groupBy("text_key", "part").agg(F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in dims]), "parts")
    else:
        texts = texts.withColumn("part", F.lit(0).cast("long"))
    is_heavy = F.col("weight") * shards * fine > total
    heavy = sorted(((bytes(r.text_key), r.part, r.weight) for r in texts.where(is_heavy).select("text_key", "part", "weight").collect()), key=lambda x: (-x[2], x[0], x[1]))
    own, loads = laid([w for _, _, w in heavy], shards)
    spark = docs.sparkSession
    placed = F.broadcast(spark.createDataFrame([(bytearray(k), p, s) for (k, p, _), s in zip(heavy, own, strict=True)], "text_key binary, part long, shard int"))
    light = texts.where(~is_heavy)
    # dimensions scaled to whole numbers, so that all are as wide over the table
    ends = light.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))]).first()
    scaled = {}
    for d in dims:
        low, high = ends[f"low_{d}"], ends[f"high_{d}"]
        scaled[d] = F.lit(0).cast("long") if low is None or not high > low else F.floor((F.coalesce(F.col(d), F.lit(low)) - low) / (high - low) * ((1 << VALUE_BITS) - 1)).cast("long")
    points = written(light.select("text_key", "part", "weight", *[c.alias(d) for d, c in scaled.items()]), "points")
    takes = space(loads, total - sum(w for _, _, w in heavy))
    leaves = tree(points, takes, list(dims)).select("text_key", "part", "shard")
    both = rows.select("key", "size", "crc", "text_key", "part")
    out = both.join(placed, ["text_key", "part"]).unionByName(both.join(placed, ["text_key", "part"], "left_anti").join(leaves, ["text_key", "part"]))
    out = numbered(out.select("key", "size", "crc", "shard"))
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_sharding": op13_sharding}
ORACLES: dict[str, str] = {}
