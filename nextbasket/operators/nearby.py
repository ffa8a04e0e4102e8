"""Scores of baskets from lists of neighbours, a basket at a time.

An edge lies in the list of its item. A basket gets the list of each of its items once, whatever the number of its queries, and a
task reads its baskets in order: what is shuffled grows with the baskets' items, and a row for each query and neighbour
is made only where such rows are the result. Of a query's neighbours the counts, the best or all leave the task."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows that leave a task at once.
ROWS = 50_000
KEY_TYPES = "order_id bigint, target bigint"


def neighbours(edges: DataFrame, weights: list[str], about: list[str] = ()) -> DataFrame:
    """``(a, z)``: an item's neighbours ``c`` of ``edges``, with the day of ``available_from`` and the columns named."""
    start = F.unix_date("available_from") if "available_from" in edges.columns else F.lit(None).cast("int")
    cell = F.struct("c", F.coalesce(start, F.lit(NEVER)).alias("start"), *[F.col(w).cast("double").alias(w) for w in (*weights, *about)])
    return edges.groupBy("a").agg(F.collect_list(cell).alias("z"))


def lists(edges: DataFrame, weights: list[str], about: list[str] = ()) -> DataFrame:
    """The rows of ``neighbours``, packed."""
    return neighbours(edges, weights, about).select("a", F.arrow_udf(pack, "binary")("z").alias("z"))


def pack(z: pa.Array) -> pa.Array:
    """Lists of neighbours as bytes."""
    flat, end = z.flatten(), z.offsets.to_numpy() - z.offsets[0].as_py()
    columns = [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]
    return pa.array([packed([x[s:e] for x in columns]) for s, e in zip(end[:-1], end[1:], strict=True)], pa.binary())


#: The day of neighbours that have none.
NEVER = 2147483647


def packed(columns: list[np.ndarray]) -> bytes:
    """Ids, days and numbers of some neighbours in a few bytes: equal numbers, of which there are many, come together, and bytes of one place."""
    by = np.lexsort(columns[::-1]) if len(columns) < 3 else np.lexsort((columns[0], *columns[:1:-1]))
    kinds = ["<i8", "<i4", *["<f8"] * (len(columns) - 2)]
    return zlib.compress(b"".join(np.ascontiguousarray(x[by].astype(t)).view(np.uint8).reshape(len(by), np.dtype(t).itemsize).T.tobytes() for x, t in zip(columns, kinds, strict=True)), 1)


def unpacked(z: bytes | None, n: int) -> tuple[np.ndarray, ...]:
    """The columns of ``packed``, ``n`` of them behind the ids and days."""
    data = b"" if z is None else zlib.decompress(z)
    m = len(data) // (12 + 8 * n)
    places = [(8, 0, "<i8"), (4, 8, "<i4"), *[(8, 12 + 8 * k, "<f8") for k in range(n)]]
    return tuple(np.ascontiguousarray(np.frombuffer(data, np.uint8, w * m, at * m).reshape(w, m).T).view(t).reshape(-1) for w, at, t in places)


class Coded(NamedTuple):
    """Numbers about neighbours that take few values: ``values`` has an array a column, ``rows`` their place ``code`` in place of the columns."""

    rows: DataFrame
    values: list[np.ndarray]


class Made(NamedTuple):
    """Weights that are made of fewer numbers: lists hold ``columns``, and ``of`` makes the weights of them."""

    columns: list[str]
    of: Callable


#: Distinct values that are sent to all tasks.
SENT = 1_000_000


def coded(about: DataFrame, names: list[str]) -> Coded | None:
    """``about`` with one number for the columns named; None if they take more than ``SENT`` values."""
    kinds = written(about.select(*names).distinct(), "kinds")
    if not names or kinds.count() > SENT:
        return None
    table = kinds.sort(*names).toArrow()  # SENT rows at most
    place = about.sparkSession.createDataFrame(table.append_column("code", pa.array(np.arange(len(table)), pa.int64())))
    return Coded(about.join(F.broadcast(place), names).drop(*names), [table.column(c).to_numpy() for c in names])


def streamed(queries: DataFrame, near: DataFrame | None, weights: list[str], about: list[str], step: Callable, schema: str, own: DataFrame | None = None, coded: Coded | None = None, made: Made | None = None) -> DataFrame:
    """The rows that ``step`` makes of each basket, from the rows ``near`` of ``neighbours``.

    With ``made`` the lists hold its columns, of which the ``weights`` are made where a list is opened.

    ``own(variant_id, <about>)`` are the same columns for items of the baskets and for targets; without a row they count as 0.
    With ``coded`` the lists hold a code for the columns ``about``. A list meets the baskets that ask for it where it is made."""
    ask = queries.groupBy("order_id").agg(F.array_distinct(F.flatten(F.collect_list("context"))).alias("a")).select("order_id", F.explode("a").alias("a"))
    asked = queries.select("order_id", "target", F.unix_date("date").alias("day"), "context")
    nothing = F.array().cast("array<double>")
    if own is not None:
        names = own.select(F.col("variant_id").alias("__v"), *[F.col(c).cast("double").alias(f"__{c}") for c in about])
        mine = F.array(*[F.coalesce(F.col(f"__{c}"), F.lit(0.0)) for c in about]).cast("array<double>").alias("own")
        asked = asked.join(names, F.col("target") == F.col("__v"), "left").select("order_id", "target", "day", "context", mine)
    else:
        asked = asked.withColumn("own", nothing)
    who = ask.groupBy("a").agg(F.collect_list(F.struct("order_id")).alias("orders"))
    who = who.withColumn("own", nothing) if own is None else who.join(names, F.col("a") == F.col("__v"), "left").select("a", "orders", mine)
    if near is None:
        held = who.withColumn("z", F.lit(None).cast("binary"))
    else:
        # only the askers are hashed: lists are neither sorted nor dealt again before they are packed
        held = who.hint("shuffle_hash").join(near, "a", "inner" if own is None else "left").select("a", "orders", "own", F.arrow_udf(pack, "binary")("z").alias("z"))
    held = held.select(F.inline("orders"), "a", "own", "z")
    null = lambda t: F.lit(None).cast(t)
    # the queries of a basket come after its lists
    rows = held.select("order_id", F.lit(0).alias("kind"), F.col("a").alias("item"), null("int").alias("day"), null("array<bigint>").alias("context"), "own", "z")
    rows = rows.unionAll(asked.select("order_id", F.lit(1), "target", "day", "context", "own", null("binary")))
    return rows.repartition("order_id").sortWithinPartitions("order_id", "kind").mapInArrow(baskets(step, len(weights), len(about), pa_schema(queries, schema), None if coded is None else coded.values, made), schema)


def pa_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class Found:
    """The neighbours of a query, each once, in order of their ids: start, sums of weights, and what is about them."""

    def __init__(self, parts: list[tuple], n_weights: int, n_about: int):
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        self.ids, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        column = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)
        self.start = column(1)[first]
        self.sums = [np.bincount(inverse.reshape(-1), column(2 + k), len(self.ids)) for k in range(n_weights)]
        self.about = [column(2 + n_weights + k)[first] for k in range(n_about)]


def quantized(score: np.ndarray) -> np.ndarray:
    """As ``functions.quantized``."""
    return np.minimum(np.floor(score * 1e12 + 0.5), 9223372036854774784.0).astype(np.int64)


def baskets(step: Callable, n_weights: int, n_about: int, schema: pa.Schema, values: list[np.ndarray] | None = None, made: Made | None = None) -> Callable:
    """Calls ``step(order, {target: [(day, context, own), ..]}, find, held)`` for each basket, and sends the rows of its columns on.

    With ``values`` the last number of a neighbour is the place of those about it."""
    packed_weights, of = (n_weights, None) if made is None else (len(made.columns), made.of)
    n = packed_weights + (n_about if values is None else 1)

    def opened(z: bytes | None) -> tuple:
        columns = unpacked(z, n)
        if of is not None:
            columns = (*columns[:2], *of(*columns[2 : 2 + packed_weights]), *columns[2 + packed_weights :])
        return columns if values is None else (*columns[:-1], *[v[columns[-1].astype(np.int64)] for v in values])

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        size, started, order = 0, False, None
        held: dict[int, tuple] = {}
        asked: dict[int, list] = {}

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal size
            find = lambda context: Found([held[a][1] for a in context if a in held], n_weights, n_about)
            for target, rows in asked.items():
                for columns in step(order, target, rows, find, held):
                    size += len(columns[0])
                    for c, x in zip(out, columns, strict=True):
                        c.append(x)
                if size >= ROWS:
                    yield sent()
                    size = 0

        def sent() -> pa.RecordBatch:
            arrays = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x in c]) for c, f in zip(out, schema, strict=True)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for b in batches:
            orders, kinds, items, days, context, own, near = (b.column(k).to_pylist() for k in range(7))
            for i, (o, kind) in enumerate(zip(orders, kinds, strict=True)):
                if not started or o != order:
                    yield from closed()
                    started, order, held, asked = True, o, {}, {}
                if kind == 1:
                    asked.setdefault(items[i], []).append((days[i], context[i], own[i]))
                else:
                    held[items[i]] = own[i], opened(near[i])
        yield from closed()
        if size:
            yield sent()

    return run


def scored(queries: DataFrame, edges: DataFrame, weights: list[str]) -> DataFrame:
    """``(order_id, target, variant_id, <weights>)``: sums over the context of each weight of ``edges(a, c, ..)``."""

    def step(order, target, rows, find, held):
        f = find([a for _, context, _ in rows for a in context])
        n = len(f.ids)
        if n:
            yield [pa.repeat(pa.scalar(order, pa.int64()), n), pa.repeat(pa.scalar(target, pa.int64()), n), f.ids, *f.sums]

    schema = f"{KEY_TYPES}, variant_id bigint, " + ", ".join(f"{w} double" for w in weights)
    return streamed(queries, neighbours(edges.drop("available_from"), weights), weights, [], step, schema)


def gathered(queries: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """``(order_id, target, item_ids, item, top_item, at_item)``: the rows of ``scored`` above 0 as lists, their most and the target's."""

    def step(order, target, rows, find, held):
        f = find([a for _, context, _ in rows for a in context])
        at = np.flatnonzero(f.sums[0] > 0)
        if order is not None and len(at):
            score = f.sums[0][at]
            own = score[f.ids[at] == target]
            yield [[order], [target], [f.ids[at]], [score], [score.max()], [own[0] if len(own) else None]]

    schema = f"{KEY_TYPES}, item_ids array<bigint>, item array<double>, top_item double, at_item double"
    return streamed(queries, neighbours(edges.drop("available_from"), [weight]), [weight], [], step, schema)


def allowed(f: Found, k: int, rows: list[tuple]) -> np.ndarray:
    """Places of the candidates by weight ``k``, for each query of the key: scored, there on the day and not in the context."""
    some = [np.flatnonzero((f.sums[k] > 0) & (f.start <= day) & ~np.isin(f.ids, context)) for day, context, _ in rows if day is not None]
    return np.concatenate(some) if some else np.zeros(0, np.int64)


def candidates(queries: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """``(order_id, target, variant_id, qs)`` over ``edges(a, c, available_from, ..)``: available on the day, not in the context, score above 0."""

    def step(order, target, rows, find, held):
        f = find([a for _, context, _ in rows for a in context])
        at = allowed(f, 0, rows)
        if len(at) and order is not None:
            yield [pa.repeat(pa.scalar(order, pa.int64()), len(at)), pa.repeat(pa.scalar(target, pa.int64()), len(at)), f.ids[at], quantized(f.sums[0][at])]

    return streamed(queries, neighbours(edges, [weight]), [weight], [], step, f"{KEY_TYPES}, variant_id bigint, qs bigint")


def counts(queries: DataFrame, edges: DataFrame, weights: list[str]) -> DataFrame:
    """``(order_id, target, m, n_scored, qt, above, same)``: what ``evaluate.expected_ranks`` counts of a query's candidates, for weight ``m``."""

    def step(order, target, rows, find, held):
        if order is None:
            return
        f = find([a for _, context, _ in rows for a in context])
        for m in range(len(weights)):
            at = allowed(f, m, rows)
            if not len(at):
                continue
            qs = quantized(f.sums[m][at])
            own = qs[f.ids[at] == target]
            above, same = sum(int((qs > t).sum()) for t in own), sum(int((qs == t).sum()) for t in own)
            yield [[order], [target], [m], [len(at) * max(1, len(own))], [int(own.max()) if len(own) else None], [above], [same]]

    return streamed(queries, neighbours(edges, weights), weights, [], step, f"{KEY_TYPES}, m int, n_scored bigint, qt bigint, above bigint, same bigint")


def listed(queries: DataFrame, edges: DataFrame, weight: str, k: int) -> DataFrame:
    """``(order_id, target, top)``: the first ``k`` candidates by score and id."""

    def step(order, target, rows, find, held):
        if order is None:
            return
        f = find([a for _, context, _ in rows for a in context])
        at = allowed(f, 0, rows)
        if len(at):
            yield [[order], [target], [f.ids[at][np.lexsort((f.ids[at], -quantized(f.sums[0][at])))[:k]].tolist()]]

    return streamed(queries, neighbours(edges, [weight]), [weight], [], step, f"{KEY_TYPES}, top array<bigint>")


def prior_counts(queries: DataFrame, edges: DataFrame | None, weights: list[str], priors: list[str], own: DataFrame, which: list[tuple[int | None, int]], coded: Coded | None = None, made: Made | None = None) -> DataFrame:
    """``(order_id, target, qt, above, same, n)``, arrays with a place for each model: the target's key, and what scored candidates and
    context items change in the counts over all priors. A model is a place in ``weights`` (or none) and one in ``priors``.

    ``edges`` carry ``available_from`` and the priors of ``c``; ``own`` has the priors of any item. With ``coded`` the edges carry its code for them."""
    score_of, prior_of = np.array([len(weights) if w is None else w for w, _ in which]), np.array([p for _, p in which])

    def step(order, target, rows, find, held):
        f = find([a for _, context, _ in rows for a in context])
        here, k = np.flatnonzero(f.ids == target), len(f.ids)
        # all models at once: a row each; models without a score have none of the candidates
        score, prior = np.vstack([*f.sums, np.zeros(k)])[score_of], np.array(f.about).reshape(len(priors), k)[prior_of]
        t = quantized((score[:, here[0]] if len(here) else 0.0) + np.array(rows[0][2])[prior_of])[:, None]
        kept = quantized(np.array([held[a][0] for _, context, _ in rows for a in context]).reshape(-1, len(priors)).T[prior_of])
        full, bare = quantized(score + prior), quantized(prior)
        above, same, n = -(kept > t).sum(1), -(kept == t).sum(1), -(kept > 0).sum(1)
        up, tied, more = (full > t) * 1 - (bare > t), (full == t) * 1 - (bare == t), (bare <= 0) * 1
        for day, context, _ in rows:
            if day is not None:
                ok = (score > 0) & (f.start <= day)
                ok[:, np.isin(f.ids, context)] = False
                above, same, n = above + (up * ok).sum(1), same + (tied * ok).sum(1), n + (more * ok).sum(1)
        yield [[order], [target], *[[x] for x in (t[:, 0], above, same, n)]]

    near = None if edges is None else neighbours(edges, weights if made is None else made.columns, priors if coded is None else ["code"])
    arrays = ", ".join(f"{n} array<bigint>" for n in ("qt", "above", "same", "n"))
    return streamed(queries, near, weights, priors, step, f"{KEY_TYPES}, {arrays}", own, coded, made)


def firsts(queries: DataFrame, edges: DataFrame, weights: list[str], priors: list[str], which: list[tuple[int, int]], k: int, coded: Coded | None = None, made: Made | None = None) -> DataFrame:
    """``(m, order_id, target, variant_id, score)``: the candidates that can be among the first ``k`` by score plus prior,
    rounded at 1e-10, and id. Of equal sums the lowest ``k`` ids are kept; sums that may round alike all count."""

    def step(order, target, rows, find, held):
        if order is None:
            return
        f = find([a for _, context, _ in rows for a in context])
        for m, (w, p) in enumerate(which):
            at = np.unique(allowed(f, w, rows))
            if not len(at):
                continue
            value = f.sums[w][at] + f.about[p][at]
            by = np.lexsort((f.ids[at], -value))
            at, value = at[by], value[by]
            edge = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            place = np.arange(len(at)) - np.repeat(edge, np.diff(np.append(edge, len(at))))
            keep = at[(place < k) & (value >= value[min(k, len(at)) - 1] - 2e-10)]
            yield [np.full(len(keep), m, np.int32), np.full(len(keep), order), np.full(len(keep), target), f.ids[keep], f.sums[w][keep]]

    return streamed(queries, neighbours(edges, weights if made is None else made.columns, priors if coded is None else ["code"]), weights, priors, step, f"m int, {KEY_TYPES}, variant_id bigint, score double", coded=coded, made=made)
