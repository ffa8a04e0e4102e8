"""Scores from lists of neighbours against plain joins."""

import random
import time
from datetime import date

from pyspark.sql import functions as F

from nextbasket.operators import evaluate, models, nearby, serve, sweep


def shuffled_rows(spark, df):
    """Rows that the stages of a run write for others."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    rows = df.collect()
    time.sleep(2)
    after = stages()
    return rows, sum(after.apply(i).shuffleWriteRecords() for i in range(after.size()) if after.apply(i).stageId() not in before)


def rounded(df):
    return df.withColumn("score", F.round("score", 9))


def test_streamed_neighbours_equal_joined_rows(spark):
    r = random.Random(11)
    lines = [(o, date(2026, 1, 1) if o < 40 else date(2026, 3, r.choice([1, 2])), "pos", v, 1) for o in range(60) for v in r.sample(range(1, 26), r.choice([1, 2, 4, 6]))]
    lines = spark.createDataFrame(lines, "order_id long, date date, source string, variant_id long, quantity int")
    available = spark.createDataFrame([(v, date(2026, 3, 2) if v in (3, 9) else date(2026, 1, 1)) for v in range(1, 31)], "variant_id long, available_from date")
    fit, queries = models.baskets(lines.where("order_id < 40")), models.loo_queries(models.baskets(lines.where("order_id >= 40")))
    edges, near = models.itemitem(fit), models.itemitem(fit, about=available)
    ctx = queries.select(*evaluate.KEYS, F.explode("context").alias("a"))
    plain = ctx.join(edges, "a").groupBy(*evaluate.KEYS, F.col("c").alias("variant_id")).agg(F.sum("sim").alias("score"))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)
    assert same(rounded(evaluate.score_neighbours(queries, edges, "sim")), rounded(plain)) and plain.count() > 500
    cand = evaluate.candidates(queries, plain, available)
    assert same(nearby.candidates(queries, near, "sim"), cand)
    assert same(evaluate.closed_form(queries, nearby.counts(queries, near, ["sim"]).drop("m"), available), evaluate.expected_ranks(queries, cand, available))
    assert same(evaluate.filled(queries, nearby.listed(queries, near, "sim", 5), available, 5), evaluate.top_k(queries, cand, available, 5))
    which = {n: sweep.edge_models()[n] for n in ("popularity", "copurchase(min_support=2)+pop", "itemitem(lift, shrink=5)")}
    prior, wide = sweep.units_shares(lines.where("order_id < 40")), sweep.edge_scores(queries, fit)
    own = sweep.Edges(fit, prior, available, which)
    assert same(own.ranks(queries), sweep.ranks(queries, wide, prior, available, which))
    every, firsts = available.withColumns({"status": F.lit("ACTIVE"), "in_stock": F.lit(None).cast("boolean")}), own.firsts(queries, 5)
    assert firsts["popularity"] is None
    for name in list(which)[1:]:
        score, tie = which[name]
        scores = wide.select(*evaluate.KEYS, "variant_id", F.expr(score).alias("score")).where("score > 0")
        p = prior.select("variant_id", F.expr(tie).alias("prior"))
        assert same(serve.recommend(queries, firsts[name], every, p, 5), serve.recommend(queries, scores, every, p, 5))


def test_scores_of_queries_are_not_shuffled(spark):
    """Two items that were sold with 400 others each: a basket of four has some 4,800 scored candidates, which stay in the task."""
    fit = spark.createDataFrame([(o, [1 + o % 4, 100 + o]) for o in range(1600)], "order_id long, items array<long>")
    available = spark.createDataFrame([(v, date(2026, 1, 1)) for v in (*range(1, 5), *range(100, 1700))], "variant_id long, available_from date")
    queries = models.loo_queries(spark.createDataFrame([(o, date(2026, 3, 1), "pos", [1, 2, 3, 4]) for o in range(5000, 5020)], "order_id long, date date, source string, items array<long>"))
    rows, moved = shuffled_rows(spark, evaluate.score_neighbours(queries, models.itemitem(fit), "sim"))
    assert len(rows) == 20 * 4 * 1200 and moved < 20_000


def test_edges_are_shuffled_once(spark):
    """200 baskets of 12 items make 26,400 edges; without broadcast joins they were shuffled as pairs and twice in both directions."""
    fit = spark.createDataFrame([(o, [12 * o + k for k in range(12)]) for o in range(200)], "order_id long, items array<long>")
    available = spark.createDataFrame([(v, date(2026, 1, 1)) for v in range(2400)], "variant_id long, available_from date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = shuffled_rows(spark, nearby.lists(models.itemitem(fit, about=available), ["sim"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 2400 and moved < 45_000


def test_edges_of_asked_items_and_packed_lists(spark):
    fit = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3]), (3, [3])], "order_id long, items array<long>")
    known = spark.createDataFrame([(1, None), (2, date(2026, 1, 1))], "variant_id long, available_from date")
    edges = models.itemitem(fit, shrink=0.0, about=known, asked=spark.createDataFrame([(3,), (3,), (9,)], "a long"))
    assert sorted((r.a, r.c, round(r.sim, 6)) for r in edges.collect()) == [(3, 1, 0.57735), (3, 2, 0.816497)]
    (row,) = nearby.lists(edges, ["sim"]).collect()
    ids, start, sim = nearby.unpacked(bytes(row.z), 1)
    assert dict(zip(ids.tolist(), start.tolist(), strict=True)) == {1: nearby.NEVER, 2: 20454} and sim.round(6).tolist() == [0.57735, 0.816497]
    assert [len(x) for x in nearby.unpacked(None, 2)] == [0, 0, 0, 0]


def test_lists_are_packed_before_they_are_dealt_and_priors_are_coded(spark):
    """Lists of 300 neighbours, asked for by one basket: they are shuffled once, as bytes, to that basket; their priors, doubles of
    12 values, are codes."""
    fit = spark.createDataFrame([(1, list(range(300))), (2, [5, 6])], "order_id long, items array<long>")
    available = spark.createDataFrame([(v, date(2026, 1, 1)) for v in range(310)], "variant_id long, available_from date")
    prior = spark.createDataFrame([(v, (v % 12) / 7) for v in range(300)], "variant_id long, u double")
    queries = models.loo_queries(spark.createDataFrame([(9, date(2026, 3, 1), "pos", [1, 2, 3])], "order_id long, date date, source string, items array<long>"))
    name, n = "copurchase(min_support=1)+pop", 9
    own = sweep.Edges(fit, prior, available, {name: sweep.edge_models()[name]})
    assert [len(v) for v in own.coded.values] == [12] and "code" in own.edges.columns and "p0" not in own.edges.columns
    with_codes = sorted(map(tuple, own.ranks(queries).collect()))
    before, nearby.SENT = nearby.SENT, n  # more values than are sent
    try:
        plain = sweep.Edges(fit, prior, available, {name: sweep.edge_models()[name]})
    finally:
        nearby.SENT = before
    assert plain.coded is None and sorted(map(tuple, plain.ranks(queries).collect())) == with_codes and len(with_codes) == 3
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nearby.counts(queries, models.itemitem(fit, about=available), ["sim"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    pack = plan.split("ArrowEvalPython")[0]
    assert pack.count("Exchange") == 1 and "ShuffledHashJoin" in plan
