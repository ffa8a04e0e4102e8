"""Universe, queries, features and the fitted models, as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import item_tokens
from ..sources.scratch import written


def availability(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Each variant from the day of its listing or its first sale, whichever is earlier."""
    both = products.select("variant_id", F.col("created_at").alias("d")).union(lines.select("variant_id", "date"))
    return both.groupBy("variant_id").agg(F.min("d").alias("available_from"))


def universe_on(available: DataFrame, days: DataFrame) -> DataFrame:
    """``(date, n_universe)``: variants that exist on each of ``days(date)``."""
    starts = available.groupBy(F.col("available_from").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # days are few: events of both kinds share one running sum
    events = starts.select("d", "n", F.lit(0).alias("ask")).union(days.select("date").distinct().select("date", F.lit(0), F.lit(1)))
    run = F.sum("n").over(W.orderBy("d", "ask").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("n_universe", run).where("ask = 1").select(F.col("d").alias("date"), "n_universe")


def time_split(lines: DataFrame, train_end: str, val_end: str) -> DataFrame:
    part = F.when(F.col("date") <= F.lit(train_end).cast("date"), "train").when(F.col("date") <= F.lit(val_end).cast("date"), "val").otherwise("test")
    return lines.withColumn("part", part)


def baskets(lines: DataFrame) -> DataFrame:
    """Distinct sorted variants of each order."""
    return lines.groupBy("order_id", "date", "source").agg(F.array_sort(F.collect_set("variant_id")).alias("items"))


def loo_queries(rows: DataFrame) -> DataFrame:
    """Every item of every basket of two or more is the hidden target once."""
    out = rows.where(F.size("items") >= 2).select("order_id", "date", "source", "items", F.explode("items").alias("target"))
    return out.select("order_id", "date", "source", "target", F.array_remove("items", F.col("target")).alias("context"))


def tokens(products: DataFrame) -> DataFrame:
    return products.select("variant_id", F.explode(item_tokens(F.col("title"), F.col("tags"), F.col("price"))).alias("token"))


def token_idf(rows: DataFrame, n_universe: int) -> DataFrame:
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(n_universe) + 1) / (F.col("df") + 1)) + 1)


def vectors(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """idf weights of unit length: ``(variant_id, token, w)``."""
    # summed in one order: equal tokens have equal vectors, to the last bit
    by = W.partitionBy("variant_id").orderBy("token").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(by))
    return rows.join(idf, "token").select("variant_id", "token", (F.col("idf") / norm).alias("w"))


def popularity(lines: DataFrame, half_life: int | None = None) -> DataFrame:
    """Units by variant; with a half-life in days, decayed from the last day."""
    if half_life is None:
        return lines.groupBy("variant_id").agg(F.sum("quantity").alias("units"))
    last = lines.agg(F.max("date").alias("ref"))
    weight = F.pow(F.lit(0.5), F.datediff("ref", "date") / half_life)
    return lines.join(F.broadcast(last)).groupBy("variant_id").agg(F.sum(F.col("quantity") * weight).alias("units"))


def pairs(rows: DataFrame) -> DataFrame:
    """``(a, c, n)`` with a < c: baskets that hold both. Pairs are made inside the row."""
    one = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("c")))))
    return rows.where(F.size("items") >= 2).select(F.inline(one)).groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"))


def mirrored(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "c")]
    return edges.select(F.inline(F.array(F.struct("a", "c", *rest), F.struct(F.col("c").alias("a"), F.col("a").alias("c"), *rest))))


def known(edges: DataFrame, about: DataFrame) -> DataFrame:
    """``edges`` with what ``about(variant_id, ..)`` says of ``c``; those without a row go."""
    return edges.join(about.withColumnRenamed("variant_id", "c"), "c")


def counted(rows: DataFrame, about: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``(a, c, k, na, nc, <about>)``, both directions: baskets with both and with each. With ``about``, ``c`` without a row there go;
    with ``asked(a)``, only edges of its items are made. Rows of ``rows`` differ in another column than ``items``.

    What is known of an item goes to its baskets, and only there pairs are made: they are shuffled once, by ``a``, so that lists of ``a`` need no shuffle."""
    keys = [c for c in rows.columns if c != "items"]
    rest = [] if about is None else [c for c in about.columns if c != "variant_id"]
    own = rows.select(F.explode("items").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ends, starts = F.lit(True), F.lit(True)
    if about is not None:
        own, ends = own.join(about.select(F.col("variant_id").alias("v"), *rest, F.lit(True).alias("ends")), "v", "left"), F.coalesce("ends", F.lit(False))
    if asked is not None:
        own, starts = own.join(asked.select(F.col("a").alias("v"), F.lit(True).alias("starts")).distinct(), "v", "left"), F.coalesce("starts", F.lit(False))
    own = own.select("v", "n", *rest, ends.alias("ends"), starts.alias("starts"))
    sold = rows.where(F.size("items") >= 2).select(*keys, F.explode("items").alias("v")).join(own, "v")
    z = sold.repartition("order_id").groupBy(*keys).agg(F.collect_list(F.struct("v", "n", *rest, "ends", "starts")).alias("z"))
    edge = lambda x, y: F.struct(x["v"].alias("a"), y["v"].alias("c"), x["n"].alias("na"), y["n"].alias("nc"), *[y[r].alias(r) for r in rest])
    of = lambda x: F.transform(F.filter("z", lambda y: y["ends"] & (y["v"] != x["v"])), lambda y: edge(x, y))
    each = z.select(F.inline(F.flatten(F.transform(F.filter("z", lambda x: x["starts"]), of)))).repartition("a")
    first = [F.first(c).alias(c) for c in ("na", "nc", *rest)]
    return each.groupBy("a", "c").agg(F.count(F.lit(1)).alias("k"), *first).select("a", "c", "k", "na", "nc", *rest)


def itemitem(rows: DataFrame, kind: str = "cosine", shrink: float = 5.0, about: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``(a, c, sim, <about>)``, both directions, of the items ``asked(a)`` if given. For lift, N counts baskets of one item too."""
    return similarities(rows, {"sim": (kind, shrink)}, about, asked)


def similarities(rows: DataFrame, which: dict[str, tuple[str, float]], about: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Several of ``itemitem`` as columns of the same edges."""
    e, k, both = counted(rows, about, asked), F.col("k"), F.col("na") * F.col("nc")
    if any(kind != "cosine" for kind, _ in which.values()):
        e = e.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("N"))))
    of = {n: k / (F.sqrt(both) + s) if kind == "cosine" else k / (k + s) * k * F.col("N") / both for n, (kind, s) in which.items()}
    rest = [] if about is None else [c for c in about.columns if c != "variant_id"]
    return e.select("a", "c", *[w.alias(n) for n, w in of.items()], *rest)


def edges_of(rows: DataFrame, column: str, asked: DataFrame | None = None) -> DataFrame:
    """``(a, c, sim)`` for a score column of ``sweep.edge_scores``: a pair count with a least support, cosine or lift with a shrink."""
    for kind in ("cosine", "lift"):
        if column.startswith(kind):
            return itemitem(rows, kind, float(column.removeprefix(kind)), asked=asked)
    return counted(rows, asked=asked).where(F.col("k") >= int(column.removeprefix("n"))).select("a", "c", F.col("k").cast("double").alias("sim"))


def top_neighbours(sims: DataFrame, k: int = 10) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "c"))
    return sims.withColumn("rank", rank).where(F.col("rank") <= k)


#: Tokens up to which a partition adds to a whole matrix; pairs of tokens that it holds beyond; baskets at once.
DENSE, HELD, BASKETS = 2048, 4_000_000, 2000
#: Variants whose numbers are sent to all tasks (16 bytes each); more meet the baskets by a shuffle.
KNOWN = 4_000_000


def attr_counts(rows: DataFrame, toks: DataFrame) -> DataFrame:
    """``(f, g, n)``: tokens on ordered pairs of distinct items of a basket.

    Each partition adds its baskets to one Gram matrix of tokens, less the pairs within an item, and sends its sums:
    a basket's pairs are never rows. Tokens are numbers in the tasks, by their 64-bit hashes."""
    lists = toks.groupBy("variant_id").agg(F.array_sort(F.collect_list(F.xxhash64("token"))).alias("own"))
    # read four times
    known = written(lists.select("variant_id", F.xxhash64("own").alias("v"), "own"), "token-lists")
    vectors = known.groupBy("v").agg(F.first("own").alias("own"))
    if known.count() <= KNOWN and vectors.count() <= KNOWN // 8:
        variants, kinds = known.select("variant_id", "v").where("variant_id is not null").toArrow(), vectors.toArrow()  # numbers of KNOWN variants at most
        shared = rows.sparkSession.sparkContext.broadcast(tuple(listed(variants, kinds)))
        baskets = rows.where(F.size("items") >= 2).select("items")
        return named_counts(baskets.mapInArrow(lambda batches: gram(with_own(batches, *shared.value)), "f long, g long, n long"), toks)
    multi = rows.where(F.size("items") >= 2).select("order_id", F.explode("items").alias("variant_id"))
    baskets = multi.join(lists, "variant_id").groupBy("order_id").agg(F.collect_list("own").alias("own"))
    return named_counts(baskets.mapInArrow(gram, "f long, g long, n long"), toks)


def listed(variants: pa.Table, kinds: pa.Table) -> list[np.ndarray]:
    """Sorted variants, the number of the token list of each, where the lists begin, their sizes, and all tokens."""
    ids, v, k = (x.to_numpy() for x in (variants.column(0), variants.column(1), kinds.column(0)))
    order, by = np.argsort(ids), np.argsort(k)
    own = kinds.column(1).combine_chunks()
    size = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
    return [ids[order], by[np.searchsorted(k[by], v[order])], np.cumsum(size) - size, size, own.flatten().to_numpy()]


def with_own(batches, ids, number, start, size, tokens):
    """Rows ``(items)`` with the token lists of the items that have one, as ``gram`` reads them."""
    for b in batches:
        items = b.column(0)
        n = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        flat = items.flatten()
        kept, flat = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, flat), max(len(ids) - 1, 0))
        kept = kept & (ids[at] == flat) if len(ids) else np.zeros(len(flat), bool)
        which = number[at[kept]]
        ends = np.cumsum(size[which])
        place = np.repeat(start[which] - (ends - size[which]), size[which]) + np.arange(int(ends[-1]) if len(ends) else 0)
        own = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(tokens[place]))
        basket = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n)))).astype(np.int32)
        some = np.flatnonzero(np.diff(basket))
        lists = pa.ListArray.from_arrays(pa.array(basket[np.append(some, len(n))] if len(some) else np.zeros(1, np.int32)), own)
        yield pa.RecordBatch.from_arrays([pa.array(some), lists], ["order_id", "own"])


def gram(batches):
    """Sums of pairs of numbers over rows ``(order_id, own)``, ``own`` being a list of lists."""
    held: dict[int, int] = {}  # number of a token: its place in the matrix
    whole, codes, size = np.zeros((0, 0)), [], 0

    def sent(f, g, n):
        some = n != 0
        return pa.RecordBatch.from_arrays([pa.array(f[some]), pa.array(g[some]), pa.array(n[some].astype(np.int64))], ["f", "g", "n"])

    def summed(parts):
        f, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((g, f))
        f, g, n = f[order], g[order], n[order]
        edge = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (g[1:] != g[:-1]))) if len(f) else order
        return f[edge], g[edge], np.add.reduceat(n, edge) if len(edge) else n

    def within(who):
        """Places of all ordered pairs of equal numbers of ``who``, which is sorted."""
        start, n = np.searchsorted(who, who, "left"), np.bincount(who, minlength=int(who[-1]) + 1)[who] if len(who) else who
        return np.repeat(np.arange(len(who)), n), np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    for b in batches:
        for at in range(0, b.num_rows, BASKETS):
            own = b.column(1).slice(at, BASKETS)
            items = own.flatten()
            flat = items.flatten().to_numpy()
            basket = np.repeat(np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy()), pc.list_value_length(items).to_numpy())
            item = np.repeat(np.arange(len(items)), pc.list_value_length(items).to_numpy())
            tokens, code = np.unique(flat, return_inverse=True)
            code = code.reshape(-1)
            fresh = [t for t in tokens.tolist() if t not in held]
            if len(held) + len(fresh) <= DENSE:
                for t in fresh:
                    held[t] = len(held)
                if len(held) > len(whole):
                    grown = np.zeros((len(held), len(held)))
                    grown[: len(whole), : len(whole)] = whole
                    whole = grown
                place = np.array([held[t] for t in tokens.tolist()], np.int64)[code]
                k, rows = len(held), int(basket[-1]) + 1 if len(basket) else 0
                m = np.bincount(basket * k + place, minlength=rows * k).reshape(rows, k)
                # whole numbers, exact below 2 ** 24 in the one, and far below 2 ** 53 in the other
                m = m.astype(np.float32 if int(m.max(initial=0)) ** 2 * rows < 2**24 else float)
                whole += m.T @ m
                # an item's own pairs, one by one
                left, right = within(item)
                whole -= np.bincount(place[left] * k + place[right], minlength=k * k).reshape(k, k)
                continue
            # too many tokens for a matrix: sums of the pairs that occur
            for who, sign in ((basket, 1), (item, -1)):
                left, right = within(who)
                codes.append(summed([(flat[left], flat[right], np.full(len(left), sign, np.int64))]))
                size += len(codes[-1][0])
            if size >= HELD:
                yield sent(*summed(codes))
                codes, size = [], 0
    if codes:
        yield sent(*summed(codes))
    names = np.array(list(held), np.int64)
    for k in range(len(whole)):
        yield sent(np.full(len(names), names[k]), names, whole[k])


def named_counts(counts: DataFrame, toks: DataFrame) -> DataFrame:
    """``(f, g, n)`` with the tokens for their hashes."""
    names = toks.select("token").distinct().withColumn("h", F.xxhash64("token"))
    sums = counts.groupBy("f", "g").agg(F.sum("n").alias("n")).where("n <> 0")
    left, right = names.select(F.col("h").alias("f"), F.col("token").alias("tf")), names.select(F.col("h").alias("g"), F.col("token").alias("tg"))
    return sums.join(left, "f").join(right, "g").select(F.col("tf").alias("f"), F.col("tg").alias("g"), "n")


def pmi_weights(counts: DataFrame) -> DataFrame:
    """``(f, g, n, m)``: counts and PMI where it is above 0; the marginals are taken over all counts."""
    row = counts.groupBy("f").agg(F.sum("n").alias("nf"))
    col = counts.groupBy("g").agg(F.sum("n").alias("ng"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.join(row, "f").join(col, "g").join(F.broadcast(total))
    return out.select("f", "g", "n", F.log(F.col("n") * F.col("total") / (F.col("nf") * F.col("ng"))).alias("m")).where("m > 0")


def ppmi(counts: DataFrame, min_count: int = 5) -> DataFrame:
    """Positive PMI; the marginals are taken before the cut."""
    return pmi_weights(counts).where(F.col("n") >= min_count).select("f", "g", "m")
