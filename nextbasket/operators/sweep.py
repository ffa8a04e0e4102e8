"""Many models on the same queries in one pass: wide scores, a prior that breaks ties, ranks in closed form.

A model is ``name: (score, prior)``: a SQL expression over the score columns of a (query, variant) row, and one over
the columns of ``units_shares``. The score of a candidate is the sum of both; one without a row has the prior only.
Ranks of all candidates come from the scored rows and a histogram of priors by day, so unscored candidates are never listed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import evaluate, models, nearby, ranker
from .evaluate import KEYS

Models = dict[str, tuple[str, str]]

# The configurations that are compared.
HALF_LIVES = [None, 30, 90, 180]
SUPPORTS = [1, 2, 3]
SHRINKS = [0.0, 2.0, 5.0, 20.0]
MIN_COUNTS = [1, 2, 5, 10]
WEIGHTS = [0.0, 0.5, 1.0]
TIE = 1e-6


def units_shares(lines: DataFrame) -> DataFrame:
    """``(variant_id, u, u30, u90, u180)``: units, plain and decayed, as shares of their maxima."""
    ref = F.broadcast(lines.agg(F.max("date").alias("ref")))
    decay = lambda h: F.lit(1.0) if h is None else F.pow(F.lit(0.5), F.datediff("ref", "date") / h)
    names = {f"u{h or ''}": h for h in HALF_LIVES}
    units = lines.join(ref).groupBy("variant_id").agg(*[F.sum(F.col("quantity") * decay(h)).alias(n) for n, h in names.items()])
    tops = F.broadcast(units.agg(*[F.max(n).alias(f"top_{n}") for n in names]))
    return units.join(tops).select("variant_id", *[(F.col(n) / F.col(f"top_{n}")).alias(n) for n in names])


def edge_models() -> Models:
    """Popularity, co-purchase and item-item models; the score columns are those of ``edge_scores``."""
    out: Models = {"popularity" + (f"(hl={h}d)" if h else ""): ("0D", f"u{h or ''}") for h in HALF_LIVES}
    for s in SUPPORTS:
        out[f"copurchase(min_support={s})"] = (f"n{s}", "0D")
        out[f"copurchase(min_support={s})+pop"] = (f"n{s}", f"{TIE!r}D * u")
    return out | {f"itemitem({k}, shrink={s:g})": (f"{k}{s:g}", "0D") for k in ("cosine", "lift") for s in SHRINKS}


def edge_weights(rows: DataFrame, about: DataFrame | None = None, names: list[str] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``(a, c, <names>, <about>)``: weights of the score columns of ``edge_models``, all of them where no names are given; of the items ``asked(a)`` if given."""
    names = names if names is not None else list(dict.fromkeys(s for s, _ in edge_models().values() if s != "0D"))
    if all(n.startswith("n") for n in names):
        e, k = models.counted(rows, about, asked), F.col("k")
        of = {n: F.when(k >= int(n[1:]), k).otherwise(0).cast("double") for n in names}
    else:
        e = models.counted(rows, about, asked).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("N"))))
        k, both = F.col("k"), F.col("na") * F.col("nc")
        of = {f"n{s}": F.when(k >= s, k).otherwise(0).cast("double") for s in SUPPORTS}
        of |= {f"cosine{s:g}": k / (F.sqrt(both) + s) for s in SHRINKS}
        of |= {f"lift{s:g}": k / (k + s) * k * F.col("N") / both for s in SHRINKS}
    rest = [] if about is None else [c for c in about.columns if c != "variant_id"]
    return e.select("a", "c", *[of[n].alias(n) for n in names], *rest)


def made_weights(names: list[str], baskets: int) -> nearby.Made:
    """The weights of ``edge_weights`` from the counts that lists hold: what is shuffled and packed doesn't grow with the configurations."""
    counts_only = all(n.startswith("n") for n in names)

    def one(name: str, k, both):
        if name.startswith("n"):
            return np.where(k >= int(name[1:]), k, 0.0)
        if name.startswith("cosine"):
            return k / (np.sqrt(both) + float(name[6:]))
        return k / (k + float(name[4:])) * k * baskets / both

    return nearby.Made(["k"] if counts_only else ["k", "na", "nc"], lambda k, na=1.0, nc=1.0: [one(n, k, na * nc) for n in names])


def edge_scores(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Scores of all co-purchase and item-item models: one pair count and one join serve them all."""
    e = edge_weights(rows, asked=queries.select(F.explode("context").alias("a")))
    return nearby.scored(queries, e, [c for c in e.columns if c not in ("a", "c")])


def content_models() -> Models:
    return {"content_cosine": ("content", "0D")} | {f"attr_cooccurrence(min_count={c})": (f"attr{c}", "0D") for c in MIN_COUNTS}


def hybrid_models(attr: str = "attr") -> ranker.Blends:
    """All weightings of two or more components, for ``ranker``; ``attr`` names the attribute scores."""
    grid = [(a, c, i) for a in WEIGHTS for c in WEIGHTS for i in WEIGHTS if sum(w > 0 for w in (a, c, i)) > 1]
    return {f"hybrid(attr={a:g}, content={c:g}, item={i:g})": ({attr: a, "content": c, "item": i}, {"u": TIE}) for a, c, i in grid}


def ranks(queries: DataFrame, wide: DataFrame, prior: DataFrame, available: DataFrame, which: Models) -> DataFrame:
    """``(model, order_id, target, date, source, context_size, n_scored, rank)`` with ties shared."""
    columns, prior_columns = [c for c in wide.columns if c not in (*KEYS, "variant_id")], [c for c in prior.columns if c != "variant_id"]
    priors = list(dict.fromkeys(p for _, p in which.values()))
    q12 = lambda e: f"cast(floor(({e}) * 1e12D + 0.5D) as bigint)"
    own = lambda df: df.na.fill(0.0, [*columns, *prior_columns])
    at = wide.where("variant_id = target").drop("variant_id")
    qt = F.expr("array(" + ", ".join(q12(f"({s}) + {p}") for s, p in which.values()) + ")")
    asked = own(queries.join(at, KEYS, "left").join(prior.withColumnRenamed("variant_id", "target"), "target", "left"))
    asked = asked.select(*KEYS, "date", "source", "context", qt.alias("qt"))

    # candidates with a score count with it and no longer with their prior; context items lose theirs
    scored = wide.join(asked.select(*KEYS, "date", "context", "qt"), KEYS).join(available, "variant_id")
    scored = scored.where((F.col("available_from") <= F.col("date")) & ~F.array_contains("context", F.col("variant_id"))).drop("available_from", "date", "context")
    held = asked.select(*KEYS, "qt", F.explode("context").alias("variant_id"))
    rows = own(scored.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)), allowMissingColumns=True).join(prior, "variant_id", "left"))
    cell = ", ".join(f"struct({k} as m, {q12(f'({s}) + {p}')} as s, {q12(p)} as p, not held and ({s}) > 0 as scored, qt[{k}] as t)" for k, (s, p) in enumerate(which.values()))
    cells = rows.select(*KEYS, "held", F.inline(F.expr(f"filter(array({cell}), c -> held or c.scored)")))
    count = lambda s, p: F.sum(F.expr(f"if(scored, int({s}), 0) - int({p})")).alias
    part = cells.groupBy(*KEYS, "m").agg(count("s > t", "p > t")("above"), count("s = t", "p = t")("same"), count("true", "p > 0")("n"))

    kind = F.expr("array(" + ", ".join(str(priors.index(p)) for _, p in which.values()) + ")")
    each_query = asked.withColumn("kinds", kind).select(*KEYS, "date", "source", F.size("context").alias("context_size"), F.posexplode(F.arrays_zip("kinds", "qt")).alias("m", "z"))
    each_query = each_query.select("*", F.col("z.kinds").alias("kind"), F.col("z.qt").alias("v")).drop("z")
    return placed(each_query, each_query.join(part, [*KEYS, "m"], "left"), prior, available, which)


def placed(asked: DataFrame, rows: DataFrame, prior: DataFrame, available: DataFrame, which: Models) -> DataFrame:
    """Ranks from ``rows``, which are ``asked(order_id, target, date, source, context_size, m, kind, v)`` with the counts of the candidates
    that have a score, ``(above, same, n)``: the rest are counted in the priors of all that exist on a day."""
    priors, prior_columns = list(dict.fromkeys(p for _, p in which.values())), [c for c in prior.columns if c != "variant_id"]
    q12 = lambda e: f"cast(floor(({e}) * 1e12D + 0.5D) as bigint)"
    days = asked.select("date").distinct()
    # what exists before the first day counts as of that day, so that few starts meet the days; thresholds share the running sum
    exist = available.where("available_from is not null").join(F.broadcast(days.agg(F.min("date").alias("first")))).join(prior, "variant_id", "left").na.fill(0.0, prior_columns)
    each = ", ".join(f"struct({k} as kind, {q12(p)} as v)" for k, p in enumerate(priors))
    starts = exist.select(F.greatest("available_from", "first").alias("start"), F.inline(F.expr(f"array({each})"))).groupBy("start", "kind", "v").agg(F.count(F.lit(1)).alias("c"))
    hist = starts.join(F.broadcast(days), F.col("start") <= F.col("date")).groupBy("date", "kind", "v").agg(F.sum("c").alias("c"))
    points = hist.union(asked.select("date", "kind", "v").distinct().withColumn("c", F.lit(0).cast("long"))).groupBy("date", "kind", "v").agg(F.sum("c").alias("c"))
    by = W.partitionBy("date", "kind")
    run = F.sum("c").over(by.orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, 0))
    points = points.select("date", "kind", "v", (run - F.col("c")).alias("day_above"), F.col("c").alias("day_same"), F.sum(F.expr("if(v > 0, c, 0)")).over(by).alias("day_n"))

    out = rows.join(points, ["date", "kind", "v"]).na.fill(0, ["above", "same", "n"])
    rank = F.col("above") + F.col("day_above") + 1 + (F.col("same") + F.col("day_same") - 1) / 2
    name = F.element_at(F.array(*[F.lit(n) for n in which]), F.col("m") + 1)
    return out.select(name.alias("model"), *KEYS, "date", "source", "context_size", (F.col("n") + F.col("day_n")).alias("n_scored"), rank.cast("double").alias("rank"))


class Edges:
    """Models of ``edge_models`` over the baskets ``fit``: only the weights and priors they use go along with the edges."""

    def __init__(self, fit: DataFrame, prior: DataFrame, available: DataFrame, which: Models, asked: DataFrame | None = None):
        self.prior, self.available, self.which = prior, available, which
        self.scores, self.priors = list(dict.fromkeys(s for s, _ in which.values() if s != "0D")), list(dict.fromkeys(p for _, p in which.values()))
        self.names = [f"p{k}" for k in range(len(self.priors))]
        self.shares = prior.select("variant_id", *[F.expr(p).cast("double").alias(n) for n, p in zip(self.names, self.priors, strict=True)])
        self.edges, self.coded, self.made = None, None, None
        if self.scores:
            about = available.join(self.shares, "variant_id", "left").na.fill(0.0, self.names)
            # priors take few values: edges and lists carry their place
            self.coded = nearby.coded(about, self.names)
            self.made = made_weights(self.scores, 0 if all(n.startswith("n") for n in self.scores) else fit.count())
            self.edges = models.counted(fit, about if self.coded is None else self.coded.rows, asked)
        self.places = [(None if s == "0D" else self.scores.index(s), self.priors.index(p)) for s, p in which.values()]

    def ranks(self, queries: DataFrame) -> DataFrame:
        """The rows of ``ranks``, in which no scored candidate of a query is a row."""
        counts = nearby.prior_counts(queries, self.edges, self.scores, self.names, self.shares, self.places, self.coded, self.made)
        kind = F.array(*[F.lit(p) for _, p in self.places])
        rows = queries.select(*KEYS, "date", "source", F.size("context").alias("context_size")).join(counts, KEYS).withColumn("kinds", kind)
        rows = rows.select(*KEYS, "date", "source", "context_size", F.posexplode(F.arrays_zip("kinds", "qt", "above", "same", "n")).alias("m", "z"))
        rows = written(rows.select("*", F.col("z.kinds").alias("kind"), F.col("z.qt").alias("v"), "z.above", "z.same", "z.n").drop("z"), "counts")
        return placed(rows, rows, self.prior, self.available, self.which)

    def firsts(self, queries: DataFrame, k: int = 10) -> dict[str, DataFrame | None]:
        """``(order_id, target, variant_id, score)`` of each model: what ``serve.recommend`` needs of its scores; None without a score."""
        own = [(m, p) for m, p in enumerate(self.places) if p[0] is not None]
        rows = written(nearby.firsts(queries, self.edges, self.scores, self.names, [p for _, p in own], k, self.coded, self.made), "firsts")
        at = {m: n for n, (m, _) in enumerate(own)}
        return {name: rows.where(F.col("m") == at[m]).drop("m") if m in at else None for m, name in enumerate(self.which)}


def board(rows: DataFrame) -> DataFrame:
    """A row a model: means of the metrics of ``rows(model, ...)``."""
    mean = lambda c: F.avg(c).alias(c)
    return evaluate.metrics(rows).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_queries"), F.countDistinct("order_id").alias("n_baskets"), mean("hit5"), mean("hit10"), mean("ndcg10"), mean("rr"),
        F.avg(F.when(F.col("n_scored") > 0, 1.0).otherwise(0.0)).alias("answered"),
    )
