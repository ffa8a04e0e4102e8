"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words, in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, as the cluster names it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run):
    """``run`` for ``mapInArrow``, which gives memory that is free back to the system at the end of each partition.

    Workers are used again, and those that wait would hold what their last task needed."""

    def wrapped(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return wrapped


def connected(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``.

    The component is the smallest node reachable. Nodes without an edge don't appear;
    null ends are ignored. Every round points each node to its smallest neighbour,
    follows the pointers to their roots, and contracts the graph to those roots, which
    at least halves the nodes that still have edges. Only minima are grouped by node, so
    a hub is pre-aggregated before the shuffle. All state lives in written tables.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b")
    e = written(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    label: DataFrame | None = None
    spark = edges.sparkSession
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        root = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        root = written(root.select("node", F.least("node", "m").alias("root")), name)
        while True:  # pointers go down, so they have no cycle; each pass halves their length
            up = root.select(F.col("node").alias("root"), F.col("root").alias("top"))
            step = written(root.join(up, "root").select("node", F.col("top").alias("new"), "root"), name)
            moved = not step.where("new <> root").isEmpty()
            root = step.select("node", F.col("new").alias("root"))
            if not moved:
                break
        if label is None:
            label = root
        else:
            low = root.select(F.col("node").alias("root"), F.col("root").alias("top"))
            label = label.join(low, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        label = written(label, name)
        ra = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(ra, "a").join(rb, "b").where("ra <> rb")
        e = written(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name)
    if label is None:
        return spark.createDataFrame([], "node long, component long")
    return label.select("node", F.col("root").alias("component"))


def block_pairs(rows: DataFrame, key: str, node: str, cap: int) -> DataFrame:
    """Deals the nodes of each key to pairs of blocks: ``(g, left, right, node)`` for rows ``(key, node)``.

    A key of up to ``cap`` nodes is one block with itself. A larger one is split by hash into
    blocks of about ``cap``, and every two of them (and each with itself) meet in one group
    ``g``; ``left`` and ``right`` tell in which of the two a node lies. So no task sees more
    than two blocks and no pair of nodes is missed. Keys of one node are left out.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    rows = rows.join(sizes, key).withColumn("__b", F.ceil(F.col("__n") / cap))
    rows = rows.withColumn("__own", F.pmod(F.xxhash64(F.col(node), F.lit(17)), F.col("__b")))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    return rows.select(F.xxhash64(key, low, high).alias("g"), (F.col("__own") == low).alias("left"), (F.col("__own") == high).alias("right"), key, node)


def cross_blocks(rows: DataFrame, key: str, node: str, cap: int) -> DataFrame:
    """Deals nodes of each key so that nodes of different roots meet: ``(g, left, right, key, node, root)``.

    Rows are ``(key, node, root)``. A root of many nodes has blocks of its own, which never meet
    each other; small roots share blocks of about ``cap`` nodes, which meet themselves as well.
    """
    roots = rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("__m"))
    roots = roots.withColumn("__own", F.when(2 * F.col("__m") > cap, F.col("root")))
    light = roots.where("__own is null").groupBy(key).agg(F.ceil(2 * F.sum("__m") / cap).alias("__l"))
    roots = written(roots.join(light, key, "left"), "roots")
    part = F.pmod(F.xxhash64(node, F.lit(17)), F.ceil(F.col("__m") / cap))
    shared = F.pmod(F.xxhash64("root", F.lit(19)), F.col("__l"))
    block = F.when(F.col("__own").isNull(), F.xxhash64(shared, F.lit("l"))).otherwise(F.xxhash64("root", part))
    rows = written(rows.join(roots, [key, "root"]).select(key, node, "root", "__own", block.alias("__b")), "dealt")
    blocks = rows.select(key, "__own", "__b").distinct()
    a, b = blocks.toDF(key, "__oa", "a"), blocks.toDF(key, "__ob", "b")
    pairs = a.join(b, key).where("(a < b and not (__oa is not null and __oa <=> __ob)) or (a = b and __oa is null)").select(key, "a", "b")
    pairs = written(pairs, "block-pairs").withColumn("g", F.xxhash64(key, "a", "b"))
    low = rows.join(pairs.withColumn("__b", F.col("a")), [key, "__b"]).withColumns({"left": F.lit(True), "right": F.expr("a = b")})
    high = rows.join(pairs.where("a < b").withColumn("__b", F.col("b")), [key, "__b"]).withColumns({"left": F.lit(False), "right": F.lit(True)})
    return low.unionByName(high).select("g", "left", "right", key, node, "root")


def grouped(batches, key: str = "g"):
    """Whole groups, as tables, of batches that are sorted by ``key``."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for b in _then_none(batches):
        if b is not None:
            if not b.num_rows:
                continue
            held.append(b)
            if b.column(key)[b.num_rows - 1].as_py() == held[0].column(key)[0].as_py():
                continue  # one group so far
        if not held:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(edges[1:], len(keys))
        last = len(edges) if b is None else len(edges) - 1
        for s, e in zip(edges[:last].tolist(), ends[:last].tolist(), strict=True):
            yield table.slice(s, e - s)
        held = [] if b is None else table.slice(int(edges[-1])).combine_chunks().to_batches()


def _then_none(batches):
    yield from batches
    yield None


class Forest:
    """Union-find over a few nodes of one task."""

    def __init__(self, n: int):
        self.up, self.trees = list(range(n)), n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were joined already."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        self.trees -= a != b
        return a != b
