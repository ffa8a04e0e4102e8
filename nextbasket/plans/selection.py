"""Queries that compare, choose and explain models."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import evaluate, models, nearby, ranker, registry, serve, sweep
from ..operators.evaluate import KEYS
from ..sources import scratch, testdata
from . import sweep_sql
from .queries import ATTR, B, COUNTS, HYB, HYBRID_RANKS, PQ, SERVE, Blended, Data, boot_sql, hybrid_rows, query, r6, served

MEANS = ["hit5", "hit10", "ndcg10", "rr", "answered"]


def kept(spark, df: DataFrame) -> DataFrame:
    """A written copy, for frames that several jobs read."""
    return scratch.written(df, "kept")


# ---- scalars and small steps -----------------------------------------------------------------


@query(B + "select variant_id, case when price < 10 then '<10' when price < 15 then '10-15' when price < 25 then '15-25' when price < 50 then '25-50' when price < 100 then '50-100' else '100+' end as band from products")
def price_band(spark, sf):
    return testdata.products(spark, sf).select("variant_id", fn.price_band(F.col("price")).alias("band"))


@query(B + "select variant_id, substr(token, 4) as keyword from tok where token like 'kw:%'")
def title_keywords(spark, sf):
    return testdata.products(spark, sf).select("variant_id", F.explode(fn.title_keywords(F.col("title"))).alias("keyword"))


@query(B + "select distinct variant_id, part = 'train' as in_train from parts where part <> 'test'")
def seen_set(spark, sf):
    """Variants sold in each part of the fit window."""
    return Data(spark, sf).parts.where("part <> 'test'").select("variant_id", (F.col("part") == "train").alias("in_train")).distinct()


@query(B + "select order_id, target, variant_id, qs from cand")
def candidates(spark, sf):
    """Scored candidates of each query; those without a score are only counted, see ``expected_rank``."""
    d = Data(spark, sf).kept()
    return nearby.candidates(d.queries, d.itemitem(), "sim")


POP = "un as (select variant_id, sum(quantity)::double as units from parts where part <> 'test' group by 1), tie as (select variant_id, units / (select max(units) from un) as u from un)"


@query(B + f", {POP} select variant_id, round(u, 9) as share, round(u * 1e-6, 15) as tie from tie")
def pop_tiebreak(spark, sf):
    return sweep.units_shares(Data(spark, sf).fit_lines).select("variant_id", F.round("u", 9).alias("share"), F.round(F.col("u") * sweep.TIE, 15).alias("tie"))


@query(B + ATTR + PQ + "select order_id, target, count(*) as n, round(max(score), 6) as best from (select order_id, target, v.variant_id, sum(qg.q * v.w) as score from (select order_id, target, g as token, sum(q * m) as q from qp join (select * from pm where n >= 5 and m > 0) p on p.f = qp.token group by 1, 2, 3) qg join vec v using (token) group by 1, 2, 3) group by 1, 2")
def score_attr(spark, sf):
    s = Blended(Data(spark, sf).kept(), names=("attr",)).tops
    return s.where("n_attr > 0").select(*KEYS, F.col("n_attr").alias("n"), F.round("top_attr", 6).alias("best"))


# ---- ranks with a prior ----------------------------------------------------------------------

EVERY = """, al as (select q.order_id, q.target, a.variant_id, floor((coalesce({score}, 0) + coalesce({prior}, 0)) * 1e12 + 0.5)::bigint as qs from loo q join avail a on a.available_from <= q.date and not list_contains(q.context, a.variant_id)
  left join sc s on s.order_id = q.order_id and s.target = q.target and s.variant_id = a.variant_id left join tie t on t.variant_id = a.variant_id),
own2 as (select order_id, target, qs as qt from al where variant_id = target)
select '{name}' as model, order_id, target, count(*) filter (where qs > 0) as n_scored, (count(*) filter (where qs > qt) + 1 + ((count(*) filter (where qs = qt)) - 1) / 2)::double as rank from al join own2 using (order_id, target) group by 2, 3"""


def one_model(spark, sf, name: str) -> DataFrame:
    d = Data(spark, sf).kept()
    rows = sweep.Edges(d.fit, kept(spark, sweep.units_shares(d.fit_lines)), d.available, {name: sweep.edge_models()[name]}, d.asked).ranks(d.queries)
    return rows.select("model", *KEYS, "n_scored", "rank")


@query(B + f", {POP}" + EVERY.format(name="popularity", score="0", prior="t.u"))
def eval_popularity(spark, sf):
    """Popularity ranks every candidate; its histogram by day replaces the list."""
    return one_model(spark, sf, "popularity")


@query(COUNTS + f", {POP}" + EVERY.format(name="copurchase(min_support=1)+pop", score="s.score", prior="t.u * 1e-6"))
def eval_copurchase_pop(spark, sf):
    """Pair counts with ties broken by popularity."""
    return one_model(spark, sf, "copurchase(min_support=1)+pop")


# ---- sweep, refit and tables -----------------------------------------------------------------


class Window:
    """Fitted scores of one window, for the queries of another part."""

    def __init__(self, spark, d: Data, fit_parts: list[str], part: str):
        lines = d.parts.where(F.col("part").isin(fit_parts)).drop("part")
        self.fit, self.available, self.spark = d.of.where(F.col("part").isin(fit_parts)).drop("part"), d.available, spark
        if d.asked is not None:
            self.fit = self.fit.drop("date", "source")
        self.queries = kept(spark, models.loo_queries(d.of.where(F.col("part") == part)))
        self.asked = self.queries.select(F.explode("context").alias("a"))
        self.prior = kept(spark, sweep.units_shares(lines))
        self.seen = lines.select(F.col("variant_id").alias("target")).distinct().withColumn("warm", F.lit(True))
        x = kept(spark, d.vectors())
        pmi = models.pmi_weights(models.attr_counts(self.fit, models.tokens(d.products)))
        self.profile = ranker.profiles(self.queries, x, pmi, {f"attr{c}": c for c in sweep.MIN_COUNTS})
        self.items = ranker.catalog_rows(x, d.available, self.prior)
        self.tops = ranker.maxima(self.queries, self.profile, self.items, [s for s, _ in sweep.content_models().values()], counts=False)

    def edges(self, names: list[str]) -> sweep.Edges:
        return sweep.Edges(self.fit, self.prior, self.available, {n: sweep.edge_models()[n] for n in names}, self.asked)

    def all_ranks(self, singles: list[str] | None = None, hybrids: list[str] | None = None, parts: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
        """Ranks of single models, of hybrids, and the score columns (attr, item) the hybrids use.

        Without ``parts`` the hybrids take the best attribute and item model by hit10."""
        pick = lambda all_of, names: {k: v for k, v in all_of.items() if names is None or k in names}
        edge = self.edges(list(pick(sweep.edge_models(), singles))).ranks(self.queries)
        content = {name: ({score: 1.0}, {}) for name, (score, _) in pick(sweep.content_models(), singles).items()}
        by_tokens = ranker.ranks(self.queries, self.profile, self.items, self.tops, self.prior, content, shares=False)
        one = kept(self.spark, edge.unionByName(by_tokens))
        if parts is None:
            parts = chosen(one)
        self.item = kept(self.spark, nearby.gathered(self.queries, models.edges_of(self.fit, parts[1], self.asked), "sim"))
        mixed = ranker.ranks(self.queries, self.profile, self.items, ranker.with_item(self.tops, self.item), self.prior, pick(sweep.hybrid_models(parts[0]), hybrids), self.item)
        return one, mixed, parts


def family(name) -> F.Column:
    return F.regexp_extract(name, "^[a-z]+", 0)


def chosen(rows: DataFrame) -> tuple[str, str]:
    """Score columns of the best attribute model and the best item model; the first listed wins ties.

    A co-purchase component is the pair count alone: the blend has its own tie-break."""
    hit = {r.model: r.hit10 for r in sweep.board(rows).select("model", "hit10").collect()}  # a row a configuration
    all_of = sweep.edge_models() | sweep.content_models()
    best = lambda start: max((n for n in all_of if n.startswith(start)), key=lambda n: hit.get(n, 0.0))
    item, pair = best("itemitem"), best("copurchase")
    item = item if hit.get(item, 0.0) >= hit.get(pair, 0.0) else pair
    return all_of[best("attr")][0], all_of[item][0]


def config_of(hits: dict[str, float]) -> registry.Config:
    """The configuration of the best of each family and the best blend by hit10; the first listed wins ties."""
    singles = sweep.edge_models() | sweep.content_models()
    best = lambda names: max(names, key=lambda n: hits.get(n, 0.0))
    of = lambda start: best([n for n in singles if n.startswith(start)])
    pop, attr, item, pair = of("popularity"), of("attr"), of("itemitem"), of("copurchase")
    item = item if hits.get(item, 0.0) >= hits.get(pair, 0.0) else pair
    label = best(list(sweep.hybrid_models()))
    weights, _ = sweep.hybrid_models()[label]
    names = (("popularity", pop), ("attr", attr), ("content", "content_cosine"), ("item", item))
    return registry.Config(singles[pop][1], singles[attr][0], singles[item][0], tuple(weights.values()), sweep.TIE, label, names)


def swept(spark, d: Data) -> tuple[DataFrame, registry.Config]:
    """The means of all configurations, fitted on the first part and scored on the second; and what they choose."""
    one, mixed, _ = Window(spark, d, ["train"], "val").all_ranks()
    table = scratch.written(sweep.board(one.union(mixed)), "board")
    return table, config_of({r.model: r.hit10 for r in table.select("model", "hit10").collect()})  # a row a configuration


def folder_of(spark, sf, d: Data) -> str:
    """Where the choice for this table of orders is kept: a folder for its path, number of lines and days."""
    x = d.lines.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"), F.sum("quantity").alias("q")).first()
    name = hashlib.sha256(f"{sf} {x.n} {x.a} {x.b} {x.q} {testdata.TRAIN_END} {testdata.VAL_END}".encode()).hexdigest()[:16]
    return f"{scratch.folder(spark)}/models-{name}"


def selected(spark, sf, d: Data) -> registry.Config:
    """The choice for these orders: that of the table if it was made, else by a sweep, which is published."""
    folder = folder_of(spark, sf, d)
    if not registry.versions(spark, folder):
        registry.publish(spark, swept(spark, d)[1], folder)
    return registry.current(spark, folder)


@query(sweep_sql.SWEEP)
def sweep_validation(spark, sf):
    """All 43 configurations, fitted on the first part and scored on the second; the best of each family is marked. Publishes the choice."""
    d = Data(spark, sf).kept()
    table, config = swept(spark, d)
    registry.publish(spark, config, folder_of(spark, sf, d))
    names = [*sweep.edge_models(), *sweep.content_models(), *sweep.hybrid_models()]
    place = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "model string, position int")
    rows = table.join(F.broadcast(place), "model").withColumn("family", family(F.col("model")))
    best = rows.groupBy("family").agg(F.max_by("model", F.struct("hit10", -F.col("position"))).alias("best"))
    return r6(rows.join(best, "family").withColumn("wins", F.col("model") == F.col("best")).drop("best"), *MEANS)


@query(sweep_sql.CHOICE)
def chosen_configuration(spark, sf):
    """The published choice for these orders, a row a role."""
    return registry.rows_of(spark, selected(spark, sf, Data(spark, sf).kept()))


@query()
def recommend_selected(spark, sf):
    """Ten items for every basket, by the blend that selection chose for these orders, fitted on all of them."""
    d = Data(spark, sf).kept()
    return r6(served(d, selected(spark, sf, d)), "score").select(*KEYS, "slot", "variant_id", "score")


BASE, ALWAYS = "copurchase(min_support=3)", ["copurchase(min_support=3)", "copurchase(min_support=1)"]


def refitted(spark, sf) -> tuple[DataFrame, registry.Config, Window]:
    """Metric rows of the chosen models and of the fixed ones, fitted on all but the last part; the choice, and the fitted scores."""
    d = Data(spark, sf).kept()
    config = selected(spark, sf, d)
    names, singles = dict(config.names), sweep.edge_models() | sweep.content_models()
    # a component is its score alone, without the tie-break of its model
    of_part = [n for n, (score, tie) in singles.items() if score in (config.attr, config.item) and tie == "0D"]
    named = list(dict.fromkeys([names["popularity"], *ALWAYS, "content_cosine", *of_part]))
    w = Window(spark, d, ["train", "val"], "test")
    one, mixed, _ = w.all_ranks(named, [config.label], (config.attr, config.item))
    return evaluate.metrics(kept(spark, one.union(mixed))).join(w.seen, "target", "left").na.fill(False, ["warm"]), config, w


@query(sweep_sql.refitted(BASE, ALWAYS))
def refit_test(spark, sf):
    """A row a model on the last part: means, interval of hit10, lift over the baseline, warm and cold."""
    rows, config, _ = refitted(spark, sf)
    rows = kept(spark, rows)
    base = rows.where(F.col("model") == BASE).select(*KEYS, F.col("hit10").alias("base"))
    lift = rows.join(base, KEYS).withColumn("d", F.col("hit10") - F.col("base"))
    split = rows.groupBy("model").agg(F.avg(F.when(F.col("warm"), F.col("hit10"))).alias("warm10"), F.avg(F.when(~F.col("warm"), F.col("hit10"))).alias("cold10"))
    ci = evaluate.bootstrap_by(rows, "hit10", ["model"]).select("model", "lo", "hi")
    up = evaluate.bootstrap_by(lift, "d", ["model"]).select("model", F.col("mean").alias("lift"), F.col("lo").alias("lift_lo"), F.col("hi").alias("lift_hi"))
    out = sweep.board(rows.drop("hit5", "hit10", "ndcg10", "rr")).join(split, "model").join(ci, "model").join(up, "model")
    out = out.withColumns({"baseline": F.col("model") == BASE, "served": F.col("model") == config.label})
    return r6(out, *MEANS, "warm10", "cold10", "lo", "hi", "lift", "lift_lo", "lift_hi")


EXPORTED = ["popularity", "copurchase(min_support=1)", "itemitem(cosine, shrink=5)"]
EXPORT = B + f", {POP}" + """, sn as (select q.order_id, q.target, m.c as variant_id, sum(m.n)::double as score from (select order_id, target, unnest(context) as a from loo) q join mir m on m.a = q.a group by 1, 2, 3),
every as (select 'popularity' as model, order_id, target, 0 as variant_id, 0::double as score from loo where false union all select 'copurchase(min_support=1)', * from sn union all select 'itemitem(cosine, shrink=5)', * from sc),
ms(model, w) as (values ('popularity', 1::double), ('copurchase(min_support=1)', 0), ('itemitem(cosine, shrink=5)', 0)),
al as (select model, q.order_id, q.target, a.variant_id, coalesce(s.score, 0) + w * coalesce(t.u, 0) as score from ms cross join loo q join avail a on a.available_from <= q.date and not list_contains(q.context, a.variant_id)
  left join every s using (model, order_id, target, variant_id) left join tie t on t.variant_id = a.variant_id),
aq as (select *, floor(score * 1e12 + 0.5)::bigint as qs, row_number() over (partition by model, order_id, target order by round(score, 10) desc, variant_id) as slot from al),
own2 as (select model, order_id, target, qs as qt from aq where variant_id = target),
rk as (select model, order_id, target, count(*) filter (where qs > 0) as n_scored, (count(*) filter (where qs > qt) + 1 + ((count(*) filter (where qs = qt)) - 1) / 2)::double as rank, list(variant_id order by slot) filter (where slot <= 10) as top10 from aq join own2 using (model, order_id, target) group by 1, 2, 3)
select model, order_id, target, target in (select variant_id from parts where part <> 'test') as target_warm, q.date, q.source, len(q.context)::int as context_size, n_scored, rank, case when rank <= 5 then 1.0 else 0.0 end::double as hit5, case when rank <= 10 then 1.0 else 0.0 end::double as hit10,
round(case when rank <= 10 then 1 / log2(rank + 1) else 0 end::double, 6) as ndcg10, round(1 / rank, 6) as rr, top10 from rk join loo q using (order_id, target)"""


@query(EXPORT)
def export_query_results(spark, sf):
    """A row a model and query with its ten best items, written in a folder a model and read again."""
    d = Data(spark, sf).kept()
    which, prior = {n: sweep.edge_models()[n] for n in EXPORTED}, kept(spark, sweep.units_shares(d.fit_lines))
    edges = sweep.Edges(d.fit, prior, d.available, which, d.asked)
    firsts, nothing = edges.firsts(d.queries), spark.createDataFrame([], "order_id long, target long, variant_id long, score double")
    every = d.available.withColumns({"status": F.lit("ACTIVE"), "in_stock": F.lit(None).cast("boolean")})
    lists = None
    for name, (_, tie) in which.items():
        top = serve.recommend(d.queries, nothing if firsts[name] is None else firsts[name], every, prior=prior.select("variant_id", F.expr(tie).cast("double").alias("prior")))
        top = top10_of(top.withColumn("model", F.lit(name)))
        lists = top if lists is None else lists.unionByName(top)
    seen = d.fit_lines.select(F.col("variant_id").alias("target")).distinct().withColumn("target_warm", F.lit(True))
    rows = evaluate.metrics(edges.ranks(d.queries)).join(seen, "target", "left").na.fill(False, ["target_warm"])
    return exported(spark, rows, lists)


def exported(spark, rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Metric rows and lists of models, written in a folder a model and read again."""
    path = f"{scratch.folder(spark)}/results-{uuid.uuid4().hex}"
    rows.join(lists, ["model", *KEYS]).write.partitionBy("model").parquet(path)
    out = spark.read.parquet(path).select("model", *KEYS, "target_warm", "date", "source", "context_size", "n_scored", "rank", "hit5", "hit10", "ndcg10", "rr", "top10")
    return r6(out, "ndcg10", "rr")


def top10_of(top: DataFrame) -> DataFrame:
    """``(model, order_id, target, top10)`` of rows with slots."""
    return top.groupBy("model", *KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "variant_id"))), lambda x: x["variant_id"]).alias("top10"))


@query(HYB + HYBRID_RANKS + """, tk as (select order_id, target, list(variant_id order by slot) as top10 from (select *, row_number() over (partition by order_id, target order by qs desc, variant_id) as slot from al) where slot <= 10 group by 1, 2)
select 'hybrid' as model, order_id, target, warm as target_warm, q.date, q.source, len(q.context)::int as context_size, n_scored, rank, hit5, hit10, round(ndcg10, 6) as ndcg10, round(hm.rr, 6) as rr, top10 from hm join tk using (order_id, target) join loo q using (order_id, target)""")
def export_hybrid_results(spark, sf):
    """The same of the served blend."""
    d = Data(spark, sf).kept()
    b = Blended(d, counts=False, config=registry.current(spark))
    lists = top10_of(ranker.best(b.queries, b.profile, b.items, b.tops, b.config.blend(), b.item))
    return exported(spark, hybrid_rows(d, b).withColumnRenamed("warm", "target_warm"), lists)


@query()
def export_selected_results(spark, sf):
    """The same of every model that selection refits: the winners, the fixed ones and the chosen blend."""
    d = Data(spark, sf)
    rows, config, w = refitted(spark, sf)
    names = [r.model for r in rows.select("model").distinct().collect()]  # a row a model
    edge, lists = sweep.edge_models(), None
    every = d.available.withColumns({"status": F.lit("ACTIVE"), "in_stock": F.lit(None).cast("boolean")})
    singles = [n for n in names if n in edge]
    firsts, nothing = w.edges(singles).firsts(w.queries), spark.createDataFrame([], "order_id long, target long, variant_id long, score double")
    for name in singles:
        scores, prior = nothing if firsts[name] is None else firsts[name], w.prior.select("variant_id", F.expr(edge[name][1]).cast("double").alias("prior"))
        top = serve.recommend(w.queries, scores, every, prior=prior).withColumn("model", F.lit(name))
        lists = top if lists is None else lists.unionByName(top)
    blends = {n: ({s: 1.0}, {}) for n, (s, _) in sweep.content_models().items() if n in names} | {config.label: config.blend()["hybrid"]}
    blends[config.label] = ({config.attr if c == "attr" else c: x for c, x in blends[config.label][0].items()}, blends[config.label][1])
    top = ranker.best(w.queries, w.profile, w.items, ranker.with_item(w.tops, w.item), blends, w.item).select("model", *KEYS, "slot", "variant_id")
    lists = top if lists is None else lists.select("model", *KEYS, "slot", "variant_id").unionByName(top)
    return exported(spark, rows.withColumnRenamed("warm", "target_warm"), top10_of(lists))


SEG = """, sg as (select *, 'target' as segment_group, case when warm then 'warm' else 'cold' end as segment from met union all
  select *, 'source', case when source = 'pos' then 'pos' else 'online' end from met union all select *, 'context', case when context_size = 1 then '1 item' else '2+ items' end from met)"""


@query(B + SEG + " select segment_group, segment, count(*) as n, round(avg(rr), 6) as mean from sg group by 1, 2")
def segment_means(spark, sf):
    d = Data(spark, sf).kept()
    rows = evaluate.in_segments(d.ranks(d.itemitem(), "sim"))
    return r6(rows.groupBy("segment_group", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("rr").alias("mean")), "mean")


@query(B + SEG + boot_sql("sg", "hit10", "segment_group, segment") + " select segment_group, segment, mean, lo, hi from bt")
def segment_ci(spark, sf):
    """Intervals of hit10 within each segment."""
    d = Data(spark, sf).kept()
    return r6(evaluate.bootstrap_by(evaluate.in_segments(kept(spark, d.ranks(d.itemitem(), "sim"))), "hit10", ["segment_group", "segment"]), "mean", "lo", "hi")


@query(B + """, fr as (select 'itemitem' as model, avg(hit10) as hit10, avg(ndcg10) as ndcg10 from met union all select 'moved', avg(hit10), avg(ndcg10) from met union all select 'new', avg(hit10), avg(ndcg10) from met),
co as (select model, hit10 + case when model = 'moved' then 1e-6 else 0 end as hit10, ndcg10 from fr where model <> 'new'),
bo as (select fr.model, fr.hit10 as a, co.hit10 as b, fr.ndcg10 as c, co.ndcg10 as d from fr left join co using (model))
select model, 'hit10' as metric, round(a, 6) as value, abs(a - b) <= 1e-9 as same from bo where b is not null union all select model, 'ndcg10', round(c, 6), abs(c - d) <= 1e-9 from bo where b is not null union all select model, 'present', null, false from bo where b is null""")
def drift(spark, sf):
    """Means of a fresh run against a stored table, in which one model has moved by 1e-6 and one is missing."""
    d = Data(spark, sf).kept()
    one = evaluate.summary(d.ranks(d.itemitem(), "sim"), "itemitem").select("hit10", "ndcg10")
    fresh = kept(spark, one.select(F.explode(F.array(*map(F.lit, ("itemitem", "moved", "new")))).alias("model"), "*"))
    stored = kept(spark, fresh.where("model <> 'new'").withColumn("hit10", F.expr("hit10 + if(model = 'moved', 1e-6D, 0D)")))
    return r6(evaluate.drift(fresh, stored), "value")


# ---- serving ---------------------------------------------------------------------------------


@query(SERVE + """ select order_id, target, slot, variant_id, round(score, 6) as score, nullif(round(attr, 4), 0) as by_attr, nullif(round(content, 4), 0) as by_content, nullif(round(item, 4), 0) as by_item
from (select *, row_number() over (partition by order_id, target order by score desc, variant_id)::int as slot from (select *, round(attr + content + item + 1e-6 * u, 10) as score from ok)) where slot <= 10""")
def recommend_why(spark, sf):
    """Ten items of the blend for every basket, with what each component adds; null where it adds nothing."""
    top = r6(served(Data(spark, sf).kept(), registry.current(spark)), "score")
    part = lambda n: F.nullif(F.round(n, 4), F.lit(0.0)).alias(f"by_{n}")
    return top.select(*KEYS, "slot", "variant_id", "score", *[part(n) for n in ("attr", "content", "item")])


NOW = ", now as (select variant_id, sum(quantity * pow(0.5, date_diff('day', date, (select max(date) from parts)) / 30.0)) as v from parts group by 1)"
FIVE = {"popularity": "coalesce(v, 0) / (select max(v) from now)", "itemitem": "2 * item", "content": "content", "attr": "attr", "hybrid": "attr + content + item + 1e-6 * u"}


@query(SERVE + NOW + " select model, order_id, target, slot, variant_id, round(score, 6) as score from (select *, row_number() over (partition by model, order_id, target order by score desc, variant_id)::int as slot from (" + " union all ".join(f"select '{m}' as model, order_id, target, variant_id, round({e}, 10) as score from ok left join now using (variant_id)" for m, e in FIVE.items()) + ")) where slot <= 10")
def compare_models(spark, sf):
    """The same baskets through five models fitted on all orders, ten items each; single scores over their maxima."""
    config = registry.current(spark)
    which = {"popularity": ({}, {config.popularity: 1.0}), **{m: ({c: 1.0}, {}) for m, c in (("itemitem", "item"), ("content", "content"), ("attr", "attr"))}, **config.blend()}
    return r6(served(Data(spark, sf).kept(), config, which), "score").select("model", *KEYS, "slot", "variant_id", "score")
