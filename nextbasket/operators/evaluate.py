"""Scores, tie-aware ranks, metrics, intervals, selection and gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quantized
from . import nearby
from .asof import first_of_days
from .models import universe_on

KEYS = ["order_id", "target"]


def score_neighbours(queries: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """Sum over the context of an edge weight: ``(order_id, target, variant_id, score)``."""
    score = F.col(weight) if dict(edges.dtypes)[weight] == "double" else F.col(weight).cast("long")
    return nearby.scored(queries, edges, [weight]).select(*KEYS, "variant_id", score.alias("score"))


def candidates(queries: DataFrame, scores: DataFrame, available: DataFrame) -> DataFrame:
    """Scored candidates: available on the day, not in the context, score above 0."""
    rows = scores.where("score > 0").join(queries, KEYS).join(available, "variant_id")
    rows = rows.where((F.col("available_from") <= F.col("date")) & ~F.array_contains("context", F.col("variant_id")))
    return rows.select(*KEYS, "variant_id", quantized(F.col("score")).alias("qs"))


def expected_ranks(queries: DataFrame, cand: DataFrame, available: DataFrame) -> DataFrame:
    """Ranks with ties shared, in closed form: candidates without a score tie at 0 and are never listed."""
    target = cand.where("variant_id = target").select(*KEYS, F.col("qs").alias("qt"))
    agg = cand.join(target, KEYS, "left").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_scored"), F.max("qt").alias("qt"), F.count_if(F.col("qs") > F.col("qt")).alias("above"), F.count_if(F.col("qs") == F.col("qt")).alias("same")
    )
    return closed_form(queries, agg, available)


def closed_form(queries: DataFrame, agg: DataFrame, available: DataFrame) -> DataFrame:
    """The ranks of ``expected_ranks`` from the counts of a query's candidates, ``(order_id, target, n_scored, qt, above, same)``."""
    rows = queries.join(agg, KEYS, "left").join(universe_on(available, queries.select("date")), "date").na.fill(0, ["n_scored", "above", "same"])
    n_cand = F.col("n_universe") - F.size("context")
    zero = F.col("n_scored") + 1 + (n_cand - F.col("n_scored") - 1) / 2
    rank = F.when(F.col("qt").isNotNull(), F.col("above") + 1 + (F.col("same") - 1) / 2).otherwise(zero)
    return rows.select(*KEYS, "date", "source", F.size("context").alias("context_size"), "n_scored", rank.cast("double").alias("rank"))


def metrics(ranks: DataFrame) -> DataFrame:
    hit = lambda k: F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    ndcg = F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return ranks.withColumns({"hit5": hit(5), "hit10": hit(10), "ndcg10": ndcg, "rr": 1 / F.col("rank")})


def top_k(queries: DataFrame, cand: DataFrame, available: DataFrame, k: int = 10) -> DataFrame:
    """``(order_id, target, slot, variant_id)``: by score and id, filled with the lowest ids that exist and have no score."""
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("qs"), "variant_id"))
    best = cand.withColumn("slot", rank).where(F.col("slot") <= k)
    listed = best.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("slot", "variant_id"))).alias("top"))
    return filled(queries, listed.withColumn("top", F.transform("top", lambda x: x["variant_id"])), available, k)


def filled(queries: DataFrame, listed: DataFrame, available: DataFrame, k: int = 10) -> DataFrame:
    """The rows of ``top_k`` from the first scored candidates ``listed(order_id, target, top)``."""
    rows = queries.join(listed, KEYS, "left").withColumn("top", F.coalesce("top", F.array().cast("array<bigint>")))
    # for a few days, the lowest ids that exist: enough for any context and k scored ones
    days = queries.groupBy("date").agg((F.max(F.size("context")) + 2 * k).alias("need"))
    first = first_of_days(available.withColumn("by_id", F.lit(0)), days, "by_id")
    fill = first.groupBy("date").agg(F.array_sort(F.collect_list("variant_id")).alias("fill"))
    rows = rows.join(fill, "date")
    full = F.slice(F.concat("top", F.array_except(F.array_except("fill", "context"), "top")), 1, k)
    return rows.select(*KEYS, F.posexplode(full).alias("slot", "variant_id")).withColumn("slot", F.col("slot") + 1)


def summary(rows: DataFrame, model: str) -> DataFrame:
    mean = lambda c: F.avg(c).alias(c)
    return rows.agg(
        F.count(F.lit(1)).alias("n_queries"), F.countDistinct("order_id").alias("n_baskets"), mean("hit5"), mean("hit10"), mean("ndcg10"), mean("rr"),
        F.avg(F.when(F.col("n_scored") > 0, 1.0).otherwise(0.0)).alias("answered"), F.avg(F.when(F.col("warm"), 0.0).otherwise(1.0)).alias("cold_share"),
    ).withColumn("model", F.lit(model))


def segments(rows: DataFrame) -> DataFrame:
    """Hit@10 by warm or cold target, source and context size, in one pass."""
    rows = rows.select(
        "hit10", F.when(F.col("warm"), "warm").otherwise("cold").alias("target"), F.when(F.col("source") == "pos", "pos").otherwise("online").alias("source"),
        F.when(F.col("context_size") == 1, "1 item").otherwise("2+ items").alias("context"),
    )
    sets = rows.groupingSets([["target"], ["source"], ["context"]], "target", "source", "context")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.avg("hit10").alias("hit10"))
    kind = F.when(F.col("target").isNotNull(), "target").when(F.col("source").isNotNull(), "source").otherwise("context")
    return out.select(kind.alias("segment_group"), F.coalesce("target", "source", "context").alias("segment"), "n", "hit10")


def in_segments(rows: DataFrame) -> DataFrame:
    """Each row once for its target, source and context segment."""
    parts = {
        "target": F.when(F.col("warm"), "warm").otherwise("cold"), "source": F.when(F.col("source") == "pos", "pos").otherwise("online"),
        "context": F.when(F.col("context_size") == 1, "1 item").otherwise("2+ items"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("segment_group"), v.alias("segment")) for k, v in parts.items()])
    return rows.select("*", F.inline(each))


def coverage(top: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct recommended over the universe of the last day."""
    last = universe.agg(F.max_by("n_universe", "date").alias("u"))
    return top.agg(F.countDistinct("variant_id").alias("recommended")).join(last).select("recommended", (F.col("recommended") / F.col("u")).alias("coverage10"))


def novelty(top: DataFrame, units: DataFrame, n_universe: int) -> DataFrame:
    total = units.agg(F.sum("units").alias("total"))
    p = (F.coalesce("units", F.lit(0)) + 1) / (F.col("total") + n_universe)
    return top.join(units, "variant_id", "left").join(F.broadcast(total)).agg(F.avg(-F.log2(p)).alias("novelty10"))


#: Cumulative Poisson(1) probabilities, as far as doubles tell them apart from 1.
def poisson_steps() -> list[float]:
    p, total, out = 2.718281828459045**-1, 0.0, []
    for k in range(1, 16):
        total += p
        out.append(total)
        p /= k
    return out


# The multipliers and shifts that mix 32 bits.
MIX = ((16, 2246822507), (13, 3266489909))
STRIDE = 2654435769


def mixed(h: np.ndarray) -> np.ndarray:
    """32 bits in a 64-bit number, mixed."""
    for shift, factor in MIX:
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return h ^ (h >> np.uint64(16))


def poisson_weights(baskets: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights baskets x replicates, from a hash of both, so that they are the same on any partition."""
    b = baskets.astype(np.int64).view(np.uint64)
    own = mixed((b ^ (b >> np.uint64(32))) & np.uint64(0xFFFFFFFF))
    step = (np.arange(replicates, dtype=np.uint64) * np.uint64(STRIDE) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)
    u = mixed((own[:, None] + step) & np.uint64(0xFFFFFFFF)).astype(np.float64) / 4294967296.0
    return np.searchsorted(np.array(poisson_steps()), u, "right").astype(np.float64)


#: Baskets whose weights are held at once.
HELD = 500


def bootstrap_by(rows: DataFrame, value: str, by: list[str], replicates: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """``(by.., mean, lo, hi)``: percentile interval of a mean, resampling baskets with Poisson weights from a hash.

    A basket has the same weights in every group, so that groups can be compared. A partition adds its baskets to one
    sum a replicate and group, and sends only these."""
    sums = rows.groupBy(*by, "order_id").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    kinds = dict(sums.dtypes)

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            group = list(zip(*[b.column(c).to_pylist() for c in by], strict=True)) if by else [()] * b.num_rows
            known = {g: k for k, g in enumerate(dict.fromkeys(group))}
            which = np.array([known[g] for g in group], np.int64)
            order, s, n = b.column("order_id").to_numpy(), b.column("s").to_numpy().astype(float), b.column("n").to_numpy().astype(float)
            for a in range(0, b.num_rows, HELD):
                w = poisson_weights(order[a : a + HELD], replicates, seed)
                own = which[a : a + HELD]
                for g, k in known.items():
                    at = np.flatnonzero(own == k)
                    if len(at):
                        part = np.stack([s[a : a + HELD][at], n[a : a + HELD][at]]) @ w[at]
                        total[g] = total[g] + part if g in total else part
        for g, x in total.items():
            cols = [pa.array([v] * replicates, b.schema.field(c).type) for c, v in zip(by, g, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(replicates), pa.int32()), pa.array(x[0]), pa.array(x[1])], [*by, "r", "s", "n"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "r int, s double, n double"])
    means = sums.select(*by, "order_id", "s", "n").mapInArrow(run, schema).groupBy(*by, "r").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = means.where("n > 0").select(*by, (F.col("s") / F.col("n")).alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    mean = sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean"))
    return mean.join(ends, by) if by else mean.join(ends)


def bootstrap(rows: DataFrame, value: str, **kw) -> DataFrame:
    """One interval for all rows."""
    return bootstrap_by(rows, value, [], **kw)


def paired_lift(a: DataFrame, b: DataFrame, value: str, **kw) -> DataFrame:
    """Difference of two models on the same queries, with its interval."""
    return paired_lifts(a, b, (value,), **kw).drop("metric")


def paired_lifts(a: DataFrame, b: DataFrame, values: tuple[str, ...] = ("hit10", "ndcg10"), **kw) -> DataFrame:
    """``(metric, mean, lo, hi, distinguishable)`` of the differences of two models on the same queries."""
    both = a.select(*KEYS, F.struct(*values).alias("a")).join(b.select(*KEYS, F.struct(*values).alias("b")), KEYS)
    each = F.array(*[F.struct(F.lit(v).alias("metric"), (F.col(f"a.{v}") - F.col(f"b.{v}")).alias("d")) for v in values])
    out = bootstrap_by(both.select("order_id", F.inline(each)), "d", ["metric"], **kw)
    return out.withColumn("distinguishable", (F.col("lo") > 0) | (F.col("hi") < 0))


def winner(board: DataFrame) -> DataFrame:
    """Best hit10 in each family; the first listed wins ties. ``board(family, model, position, hit10)``."""
    rank = F.row_number().over(W.partitionBy("family").orderBy(F.desc("hit10"), "position"))
    return board.withColumn("r", rank).where("r = 1").drop("r")


def gates(board: DataFrame, limits: DataFrame) -> DataFrame:
    """``board(name, value)`` against ``limits(name, least)``; a missing value counts as 0."""
    return limits.join(board, "name", "left").select("name", F.coalesce("value", F.lit(0.0)).alias("value"), "least", (F.coalesce("value", F.lit(0.0)) >= F.col("least")).alias("passes"))


def gate_values(rows: DataFrame, base: DataFrame, cover: DataFrame) -> DataFrame:
    """``(name, value)`` of the gated figures of ``rows``; the lift is over the hit10 of ``base`` on the same queries."""
    cold = F.coalesce(F.avg(F.when(~F.col("warm"), F.col("hit10"))), F.lit(0.0))
    one = rows.agg(F.avg("hit10").alias("hit10"), cold.alias("cold_hit10"), F.avg(F.when(F.col("n_scored") > 0, 1.0).otherwise(0.0)).alias("answered"), F.count(F.lit(1)).alias("queries"))
    lift = rows.select(*KEYS, "hit10").join(base.select(*KEYS, F.col("hit10").alias("b")), KEYS).agg(F.avg(F.col("hit10") - F.col("b")).alias("lift_hit10"))
    row = one.join(lift).join(cover.select("coverage10"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in row.columns])))


def date_gates(spark, dates: list[tuple[str, str, str]]) -> DataFrame:
    """``(name, value, least, passes)`` of dates that must equal those agreed, as yyyymmdd."""
    number = lambda x: float(x.replace("-", ""))
    return spark.createDataFrame([(n, number(a), number(b), a == b) for n, a, b in dates], "name string, value double, least double, passes boolean")


def drift(fresh: DataFrame, stored: DataFrame, tol: float = 1e-9, metrics: tuple[str, ...] = ("hit10", "ndcg10")) -> DataFrame:
    """``(model, metric, value, same)``: do a fresh run's means agree with the stored ones? A model that is not stored fails."""
    was = stored.select("model", F.lit(True).alias("known"), *[F.col(m).alias(f"was_{m}") for m in metrics])
    one = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.abs(F.col(m) - F.col(f"was_{m}")) <= tol).alias("same")) for m in metrics]
    none = F.struct(F.lit("present").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("same"))
    return fresh.join(was, "model", "left").select("model", F.inline(F.when(F.col("known"), F.array(*one)).otherwise(F.array(none))))
