"""Rules and protocol on small literal tables."""

import hashlib
import hmac
import math
import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from nextbasket import functions as fn
from nextbasket.operators import asof, clean, evaluate, models, profile, ranker, registry, serve, sweep
from nextbasket.sources import dated, jsonl

LINE = "array<struct<pos:int,variant_id:string,product_id:string,title:string,quantity:int,refunded:int,unit_price:double>>"
SCHEMA = f"id long, created_at string, test boolean, cancelled_at string, source_name string, email string, customer_id string, line_items {LINE}"


def orders(spark, *rows):
    lines = lambda own: [(p, v, "gid://shopify/Product/7", *x) for p, v, *x in own]
    return spark.createDataFrame([(k, f"2026-01-{k:02}T09:00:00Z", *r[:2], "pos", r[2], "c1", lines(r[3])) for k, r in enumerate(rows, 1)], SCHEMA)


def stats(df):
    return {r.rule: r.n for r in clean.clean_stats(df, ["owner@example.com"]).collect()}


def test_cleaning_counts(spark):
    df = orders(
        spark,
        (False, None, None, [(1, "10", "Thing", 1, 0, 10.0), (2, None, "Tip", 1, 0, 1.0), (3, "10", "Other", 2, 0, 9.0)]),
        (True, None, None, [(1, "10", "Thing", 1, 0, 10.0)]),
        (False, "2026-01-01", None, [(1, "10", "Thing", 1, 0, 10.0)]),
        (False, None, "Owner@Example.com", [(1, "10", "Thing", 1, 0, 10.0)]),
        (False, None, None, [(1, "10", "Thing", 3, 1, 10.0), (2, "11", "Thing", 1, 1, 10.0)]),
        (False, None, None, [(1, "12", "\tTip ", 1, 0, 1.0)]),
    )
    got = stats(df)
    assert got["orders_in"] == 6 and got["orders_out"] == 2 and got["dropped_order_no_lines_left"] == 1
    assert got["dropped_test_order"] == got["dropped_cancelled_order"] == got["dropped_excluded_email_order"] == 1
    assert got["lines_partially_refunded"] == 1 and got["dropped_line_fully_refunded"] == 1 and got["lines_merged_duplicate_variant"] == 1
    assert all(r.holds for r in clean.identity(clean.clean_stats(df, ["owner@example.com"])).collect())
    first = {r.id: r["items"] for r in clean.clean_orders(df, ["owner@example.com"]).collect()}[1]
    assert [(i.title, i.quantity) for i in first] == [("Thing", 3)]


def test_anonymize(spark):
    df = clean.anonymize(clean.clean_orders(orders(spark, *[(False, None, None, [(1, f"g/{k}", "T", 1, 0, 1.0)]) for k in range(20)]), []), b"salt")
    rows = sorted(df.collect(), key=lambda r: r.order_id)
    assert [r.order_id for r in rows] == list(range(1, 21)) and [r.date for r in rows] == sorted(r.date for r in rows)
    assert rows[0].customer == hmac.new(b"salt", b"c1", hashlib.sha256).hexdigest()[:16]
    assert all(r.violations == 0 for r in clean.audit(df).collect())
    assert clean.audit_sequence(df).first().asDict() == {"gap_free": True, "dates_back": 0}


def test_scalars(spark):
    df = spark.createDataFrame([(9.99, "Iron Man #12 (Target Exclusive)"), (80.0, "Chaser"), (-1.0, None), (None, "x")], "p double, t string")
    rows = df.select(fn.price_band(F.col("p")).alias("b"), fn.title_keywords(F.col("t")).alias("k"), fn.catalog_number(F.col("t")).alias("n")).collect()
    assert [r.b for r in rows] == ["<10", "50-100", "100+", "<10"]
    assert rows[0].k == ["exclusive"] and rows[1].k == [] and rows[0].n == "12" and rows[1].n is None


def test_protocol(spark):
    lines = spark.createDataFrame(
        [(1, date(2026, 1, 10), "pos", 1, 1), (1, date(2026, 1, 10), "pos", 2, 1), (2, date(2026, 2, 10), "pos", 1, 1), (2, date(2026, 2, 10), "pos", 2, 2), (2, date(2026, 2, 10), "pos", 3, 1), (5, date(2026, 7, 1), "pos", 9, 1)],
        "order_id long, date date, source string, variant_id long, quantity int",
    )
    rows = models.baskets(lines)
    q = models.loo_queries(rows).where("order_id = 2").collect()
    assert len(q) == 3 and all(len(r.context) == 2 and r.target not in r.context for r in q)
    got = {(r.a, r.c): r.n for r in models.mirrored(models.pairs(rows)).collect()}
    assert got == {(1, 2): 2, (2, 1): 2, (1, 3): 1, (3, 1): 1, (2, 3): 1, (3, 2): 1}
    lift = {(r.a, r.c): r.sim for r in models.itemitem(rows, "lift", 0.0).collect()}
    assert abs(lift[1, 2] - 1.5) < 1e-9  # single-item baskets count in N


def test_ranks_share_ties(spark):
    queries = spark.createDataFrame([(1, 6, date(2026, 1, 1), "pos", [7])], "order_id long, target long, date date, source string, context array<long>")
    available = spark.createDataFrame([(v, date(2025, 1, 1)) for v in range(1, 8)], "variant_id long, available_from date")
    scores = spark.createDataFrame([(1, 6, 1, 5.0), (1, 6, 2, 3.0), (1, 6, 6, 3.0), (1, 6, 3, 3.0), (1, 6, 7, 9.0)], "order_id long, target long, variant_id long, score double")
    cand = evaluate.candidates(queries, scores, available)
    assert evaluate.expected_ranks(queries, cand, available).first()["rank"] == 3.0
    top = evaluate.top_k(queries, cand, available, 5).orderBy("slot").collect()
    assert [r.variant_id for r in top] == [1, 2, 3, 6, 4]


def test_stock(spark):
    cat = spark.createDataFrame([(1,), (2,)], "variant_id long")
    none = spark.createDataFrame([], "variant_id long, quantity int")
    assert [r.in_stock for r in serve.in_stock(cat, none).collect()] == [None, None]
    fed = spark.createDataFrame([(1, 3)], "variant_id long, quantity int")
    assert {r.variant_id: r.in_stock for r in serve.in_stock(cat, fed).collect()} == {1: True, 2: False}


def test_ranks_with_a_prior_equal_a_full_list(spark):
    r = random.Random(4)
    days = [date(2026, 1, k) for k in (1, 2, 3)]
    since = {v: r.choice(days) for v in range(1, 13)}
    prior = {v: r.choice([0.25, 0.5, 1.0]) for v in range(1, 9)}
    asked = [(k, t, days[2] if k % 2 else days[1], "pos", c) for k in range(12) for t, *c in [r.sample([v for v in since if since[v] <= (days[2] if k % 2 else days[1])], 3)]]
    scores = [(k, t, v, r.choice([0.0, 1.0, 2.0]), r.choice([0.0, 1e-7, 3e-7])) for k, t, *_ in asked for v in r.sample(sorted(since), 5)]
    which = {"a": ("x", "0D"), "b": ("x", "1e-6D * u"), "c": ("0D", "u"), "d": ("y", "1e-6D * u")}
    rows = sweep.ranks(
        spark.createDataFrame(asked, "order_id long, target long, date date, source string, context array<long>"), spark.createDataFrame(scores, "order_id long, target long, variant_id long, x double, y double"),
        spark.createDataFrame(list(prior.items()), "variant_id long, u double"), spark.createDataFrame(list(since.items()), "variant_id long, available_from date"), which,
    ).collect()
    got = {(x.model, x.order_id): (x["rank"], x.n_scored) for x in rows}
    sheet = {(k, v): (x, y) for k, _, v, x, y in scores}
    for k, t, day, _, ctx in asked:
        for m, f in {"a": lambda x, y, u: x, "b": lambda x, y, u: x + 1e-6 * u, "c": lambda x, y, u: u, "d": lambda x, y, u: y + 1e-6 * u}.items():
            s = {v: math.floor(f(*sheet.get((k, v), (0, 0)), prior.get(v, 0)) * 1e12 + 0.5) for v in since if since[v] <= day and v not in ctx}
            want = 1 + sum(q > s[t] for q in s.values()) + (sum(q == s[t] for q in s.values()) - 1) / 2
            assert got[m, k] == (want, sum(q > 0 for q in s.values()))


def test_ranker_equals_plain_python(spark, monkeypatch):
    """Several cells, ties between equal items, items without tokens, a query without any and one whose item has a prior only."""
    monkeypatch.setattr(ranker, "BATCH", 4)
    monkeypatch.setattr(ranker, "BLOCK", 5)
    r = random.Random(5)
    days = [date(2026, 1, k) for k in (1, 2, 3)]
    toks = {v: r.sample("abcdef", r.randint(0, 3)) for v in range(1, 21)} | {20: [], 7: ["a", "b"], 8: ["a", "b"]}
    w = {c: 1.0 + k / 7 for k, c in enumerate("abcdef")}
    since, u = {v: r.choice(days) for v in toks}, {v: r.choice([0.25, 0.5, 1.0]) for v in range(1, 15)}
    pmi = {(f, g): (r.randint(1, 9), 0.5 + r.random()) for f in "abcdef" for g in r.sample("abcdef", 3)}
    asked = [(k, t, days[2], "pos", c) for k in range(13) for t, *c in [r.sample(sorted(toks), 3)]] + [(99, 7, days[2], "pos", [20])]
    item = {(k, v): r.choice([0.5, 1.5]) for k, *_ in asked[::2] for v in r.sample(sorted(toks), 4)}
    queries = spark.createDataFrame(asked, "order_id long, target long, date date, source string, context array<long>")
    x = spark.createDataFrame([(v, c, w[c]) for v, cs in toks.items() for c in cs], "variant_id long, token string, w double")
    prior = spark.createDataFrame(list(u.items()), "variant_id long, u double")
    profile = ranker.profiles(queries, x, spark.createDataFrame([(f, g, n, m) for (f, g), (n, m) in pmi.items()], "f string, g string, n long, m double"), {"attr": 5})
    items = ranker.catalog_rows(x, spark.createDataFrame(list(since.items()), "variant_id long, available_from date"), prior)
    target = {k: t for k, t, *_ in asked}
    pairs = spark.createDataFrame([(k, target[k], v, s) for (k, v), s in item.items()], "order_id long, target long, variant_id long, score double")
    tops = ranker.with_item(ranker.maxima(queries, profile, items, ["content", "attr"]), pairs)
    which = {"h": ({"attr": 1.0, "content": 0.5, "item": 0.5}, {"u": 1e-6}), "p": ({}, {"u": 1.0})}
    ranks = {(q.model, q.order_id): (q["rank"], q.n_scored) for q in ranker.ranks(queries, profile, items, tops, prior, which, pairs).collect()}
    sums = {q.order_id: q for q in ranker.totals(queries, profile, items, tops, {"h": which["h"]}, pairs).collect()}
    lists = {}
    for q in ranker.best(queries, profile, items, tops, which, pairs, 3).orderBy("slot").collect():
        lists.setdefault((q.model, q.order_id), []).append(q.variant_id)
    for k, t, day, _, ctx in asked:
        q = {c: sum(w[c] for v in ctx if c in toks[v]) for c in "abcdef"}
        a = {g: sum(q[f] * m for (f, h), (n, m) in pmi.items() if h == g and n >= 5) for g in "abcdef"}
        parts = {"content": {v: sum(q[c] * w[c] for c in toks[v]) for v in toks}, "attr": {v: sum(a[c] * w[c] for c in toks[v]) for v in toks}, "item": {v: item.get((k, v), 0.0) for v in toks}}
        for m, (ws, ps) in which.items():
            raw = {v: sum(y * parts[c][v] / (max(parts[c].values()) or 1) for c, y in ws.items()) for v in toks}
            s = {v: raw[v] + sum(y * u.get(v, 0) for y in ps.values()) for v in toks}
            ok = [v for v in toks if since[v] <= day and v not in ctx]
            key = {v: math.floor(s[v] * 1e12 + 0.5) for v in ok}
            assert ranks[m, k] == (1 + sum(y > key[t] for y in key.values()) + (sum(y == key[t] for y in key.values()) - 1) / 2, sum(y > 0 for y in key.values()))
            assert lists[m, k] == sorted(ok, key=lambda v: (-math.floor(s[v] * 1e10 + 0.5), v))[:3]
            if m == "h":
                has = [v for v in toks if raw[v] > 0]
                assert (k in sums) == bool(has)
                if has:
                    assert sums[k].n == len(has) and abs(sums[k].total - sum(s[v] for v in has)) < 1e-9 and abs(sums[k].best - max(s[v] for v in has)) < 1e-12
    none = queries.where("order_id < 0")
    assert ranker.ranks(none, profile, items, tops, prior, which, pairs).count() == 0


def test_ranker_with_copies_and_blocks(spark):
    """A hundred items share each vector; several blocks give the rows of one, and of numpy; bounds spare most tiles."""
    r = random.Random(11)
    day = date(2026, 1, 1)
    vectors = [{f"{k}{r.randrange(6)}": 0.2 + r.random() for k in "abcd"} for _ in range(300)]
    catalog = {v: vectors[v // 100] for v in range(1000)} | {1000 + k: x for k, x in enumerate(vectors)}
    u = {v: r.choice([0.0, 0.25, 1.0]) for v in catalog}
    asked = [(k, t, day, "pos", c) for k in range(12) for t, *c in [r.sample(sorted(catalog), 4)]]
    item = {(k, v): r.choice([0.5, 1.5]) for k, *_ in asked for v in r.sample(sorted(catalog), 6)}
    queries = spark.createDataFrame(asked, "order_id long, target long, date date, source string, context array<long>")
    x = spark.createDataFrame([(v, c, w) for v, own in catalog.items() for c, w in own.items()], "variant_id long, token string, w double").repartition(4)
    prior = spark.createDataFrame(list(u.items()), "variant_id long, u double")
    profile = ranker.profiles(queries, x, spark.createDataFrame([], "f string, g string, n long, m double"), {"attr": 1})
    items = ranker.catalog_rows(x, spark.createDataFrame([(v, day) for v in catalog], "variant_id long, available_from date"), prior)
    target = {k: t for k, t, *_ in asked}
    pairs = spark.createDataFrame([(k, target[k], v, s) for (k, v), s in item.items()], "order_id long, target long, variant_id long, score double")
    which = {"h": ({"content": 1.0, "item": 0.5}, {"u": 1e-6})}
    tops = ranker.with_item(ranker.maxima(queries, profile, items, ["content"], counts=False), pairs)
    full = {q.order_id: q for q in ranker.maxima(queries, profile, items, ["content"]).collect()}
    assert all(abs(q.top_content - full[q.order_id].top_content) < 1e-12 and q.at_content == full[q.order_id].at_content for q in tops.collect())
    found = []
    for block_bytes in (64_000_000, 60_000):
        lists, looks = {}, [0, 0]
        for q in ranker.best(queries, profile, items, tops, which, pairs, block_bytes=block_bytes).orderBy("slot").collect():
            lists.setdefault(q.order_id, []).append((q.variant_id, q.score))
            looks = [looks[0] + q.looked, looks[1] + q.tiles]
        ranks = {q.order_id: (q["rank"], q.n_scored) for q in ranker.ranks(queries, profile, items, tops, prior, which, pairs, block_bytes=block_bytes).collect()}
        found.append((lists, ranks))
        assert looks[0] < looks[1]
    assert found[0] == found[1]
    for k, t, _, _, ctx in asked:
        q: dict = {}
        for v in ctx:
            for c, w in catalog[v].items():
                q[c] = q.get(c, 0.0) + w
        raw = {v: sum(q.get(c, 0.0) * w for c, w in own.items()) for v, own in catalog.items()}
        most, top = max(raw.values()), max(item.get((k, v), 0.0) for v in catalog)
        s = {v: raw[v] / most + 0.5 * item.get((k, v), 0.0) / top + 1e-6 * u[v] for v in catalog if v not in ctx}
        key = {v: math.floor(x * 1e10 + 0.5) for v, x in s.items()}
        assert [v for v, _ in found[0][0][k]] == sorted(key, key=lambda v: (-key[v], v))[:10]
        fine = {v: math.floor(x * 1e12 + 0.5) for v, x in s.items()}
        n, same = sum(y > fine[t] + 1 for y in fine.values()), sum(abs(y - fine[t]) <= 1 for y in fine.values())
        assert found[0][1][k] == (n + 1 + (same - 1) / 2, sum(y > 0 for y in fine.values()))


def test_first_items_of_days(spark):
    r = random.Random(2)
    day = lambda k: date(2026, 1, 1 + k)
    items = [(v, day(r.randrange(20)), r.choice([0.0, 1.0, 2.0])) for v in r.sample(range(1000), 300)] + [(2000, None, 0.0)]
    days = [(day(k), r.randint(1, 12)) for k in (0, 3, 4, 19)]
    got = asof.first_of_days(spark.createDataFrame(items, "variant_id long, available_from date, o double").repartition(5), spark.createDataFrame(days, "date date, need int"), "o").collect()
    want = {(d, v, k) for d, n in days for k, (_, v) in enumerate(sorted((o, v) for v, since, o in items if since and since <= d)[:n], 1)}
    assert {(x.date, x.variant_id, x.r) for x in got} == want


def test_published_choice_is_served(spark, tmp_path):
    """The latest version counts, an older one can be asked for, and another blend gives other items."""
    from nextbasket.plans import queries as q

    folder = f"{tmp_path}/models"
    assert registry.current(spark, folder) == registry.DEFAULT and registry.versions(spark, folder) == []
    first = registry.Config("u30", "attr2", "n1", (0.0, 0.0, 1.0), label="hybrid(x)", names=(("item", "copurchase(min_support=1)"),))
    assert registry.publish(spark, registry.DEFAULT, folder) == 1 and registry.publish(spark, first, folder) == 2
    assert registry.current(spark, folder) == first and registry.current(spark, folder, 1) == registry.Config("u30", "attr5", "cosine5", (1.0, 1.0, 0.5))
    assert registry.history(spark, folder).count() == 10
    sf = "/root/testdata/sf0.001"
    rows = lambda: {(x.order_id, x.target, x.slot): x.variant_id for x in q.recommend(spark, sf).collect()}
    before = rows()
    spark.conf.set(registry.FOLDER, folder)
    try:
        after = rows()
    finally:
        spark.conf.unset(registry.FOLDER)
    assert set(before) == set(after) and before != after
    # only what was bought together scores: the pair counts decide the first item
    d = q.Data(spark, sf)
    pairs = {(x.a, x.c): x.n for x in models.mirrored(models.pairs(models.baskets(d.lines))).collect()}
    for x in d.queries.limit(5).collect():
        items = [after[x.order_id, x.target, k] for k in range(1, 11)]
        scores = [sum(pairs.get((a, c), 0) for a in x.context) for c in items]
        assert scores == sorted(scores, reverse=True)


def test_attribute_counts_by_pairs_of_items(spark, monkeypatch):
    """Whole matrices, and sums of the pairs that occur where tokens are many."""
    r = random.Random(7)
    toks = {v: r.sample("abcdefgh", r.randint(1, 4)) for v in range(30)}
    baskets = [(k, r.sample(range(30), r.randint(1, 5))) for k in range(200)]
    rows, names = spark.createDataFrame(baskets, "order_id long, items array<long>"), spark.createDataFrame([(v, t) for v, own in toks.items() for t in own], "variant_id long, token string")
    want: dict = {}
    for _, items in baskets:
        for a in items:
            for b in items:
                if a != b:
                    for f in toks[a]:
                        for g in toks[b]:
                            want[f, g] = want.get((f, g), 0) + 1
    for dense, held in ((2048, 4_000_000), (3, 50), (0, 10**9)):
        monkeypatch.setattr(models, "DENSE", dense)
        monkeypatch.setattr(models, "HELD", held)
        monkeypatch.setattr(models, "BASKETS", 7)
        assert {(x.f, x.g): x.n for x in models.attr_counts(rows, names).collect()} == want
    assert models.attr_counts(rows.where("false"), names).count() == 0


def test_bootstrap_equals_numpy(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), r.randrange(60), r.random()) for _ in range(500)]
    got = {x.g: x for x in evaluate.bootstrap_by(spark.createDataFrame(rows, "g string, order_id long, v double").repartition(3), "v", ["g"], replicates=50).collect()}
    for g in "ab":
        own: dict = {}
        for k, o, v in rows:
            if k == g:
                s, n = own.get(o, (0.0, 0))
                own[o] = s + v, n + 1
        ids = np.array(sorted(own))
        w = evaluate.poisson_weights(ids, 50, 0)
        s, n = (np.array([own[o][k] for o in ids.tolist()]) for k in (0, 1))
        means = (w.T @ s) / (w.T @ n)
        assert abs(got[g].mean - s.sum() / n.sum()) < 1e-12 and np.allclose([got[g].lo, got[g].hi], np.quantile(means, [0.025, 0.975]))
    w = evaluate.poisson_weights(np.arange(4000), 100, 0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_look_back_reads_the_last_months(spark, tmp_path):
    days = [date(2025, 1 + k % 12, 1 + k % 28) for k in range(100)] + [date(2026, 3, 5), None]
    path = f"{tmp_path}/orders"
    dated.write_dated(spark.createDataFrame(list(enumerate(days)), "id long, date date"), path)
    rows = dated.read_since_last(spark, path, 100)
    assert sorted(x.date for x in rows.collect()) == sorted(d for d in days if d and (date(2026, 3, 5) - d).days <= 100)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "month" in filters and "2025-11" in filters
    dated.write_dated(spark.createDataFrame([], "id long, date date"), path)


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# a\n\t\n  # b\n\n  {"a": 1}\n{"a": null}\n')
    assert [x.a for x in jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), spark.createDataFrame([], "a int").schema).collect()] == [1, None]
    assert jsonl.write_jsonl(spark.createDataFrame([(1,), (None,)], "a int"), f"{tmp_path}/out") == 2


def test_audits_count_nulls(spark):
    line = "array<struct<variant_id:long,product_id:long,title:string,quantity:int,unit_price:double>>"
    rows = [(1, date(2026, 1, 1), None, None, [(1, 1, "t", 1, 1.0)]), (2, date(2026, 1, 1), "pos", "x", None), (3, None, "pos", None, [(None, 1, "t", None, 1.0)]), (4, date(2026, 1, 1), "web", None, [])]
    got = {x.rule: x.violations for x in clean.audit(spark.createDataFrame(rows, f"order_id long, date date, source string, customer string, items {line}")).collect()}
    assert got == {"columns": 0, "source": 1, "customer": 1, "items": 2, "variant": 2, "quantity": 2, "email": 0, "date": 1}


def test_titles_by_their_rarest_piece(spark):
    titles = [(1, "Red hat", "ACTIVE"), (2, "hat, RED", "ACTIVE"), (3, "red", "DRAFT"), (4, None, "ACTIVE"), (5, "Reading", "ACTIVE"), (6, "r", "ACTIVE"), (7, "é (red)", "ACTIVE")]
    terms = [("red",), (" RED ",), ("re",), ("r",), ("",), (None,), ("d)",), ("zzz",), ("hat, r",)]
    got: dict = {}
    for x in serve.search_titles(spark.createDataFrame(titles, "variant_id long, title string, status string"), spark.createDataFrame(terms, "term string")).orderBy("slot").collect():
        got.setdefault(x.term, []).append(x.variant_id)
    assert got == {"red": [1, 7, 2], " RED ": [1, 7, 2], "re": [5, 1, 7, 2], "d)": [7], "hat, r": [2]}


def test_configurations():
    names = [*sweep.edge_models(), *sweep.content_models(), *sweep.hybrid_models()]
    assert len(names) == len(set(names)) == 43


def test_sources_and_tokens(spark):
    names = ["pos", " web ", "shopify_draft_order", "3890849", "subscription_contract_checkout_one", None]
    rows = spark.createDataFrame(list(enumerate(names)), "k int, n string").orderBy("k").select(fn.coarse_source(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["pos", "web", "draft", "app", "other", "other"]
    df = spark.createDataFrame([("Thor SDCC", [" Marvel ", " "], 12.0)], "t string, g array<string>, p double")
    assert df.select(fn.item_tokens(F.col("t"), F.col("g"), F.col("p")).alias("x")).first().x == ["kw:convention", "price:10-15", "tag:marvel"]


def test_ids_follow_the_time_of_creation(spark):
    rows = [(1, "2026-02-01T08:00:00Z", "10"), (2, "2026-01-01T23:00:00Z", "10"), (3, "2026-01-01T01:00:00Z", "gid://shopify/ProductVariant/11")]
    line = lambda v: [(1, v, "gid://shopify/Product/9", "T", 1, 0, 1.0)]
    df = spark.createDataFrame([(k, c, False, None, "web", None, None, line(v)) for k, c, v in rows], SCHEMA)
    got = clean.anonymize(clean.clean_orders(df, []), b"salt").orderBy("order_id").collect()
    assert [str(r.date) for r in got] == ["2026-01-01", "2026-01-01", "2026-02-01"] and got[0]["items"][0].asDict() == {"variant_id": 11, "product_id": 9, "title": "T", "quantity": 1, "unit_price": 1.0}
    assert list(got[0].asDict()) == clean.COLUMNS


def test_snapshot_products(spark):
    kind = "id string, title string, tags array<string>, status string, image_url string, variants array<struct<id:string,title:string,price:double,created_at:string>>"
    df = spark.createDataFrame([("g/P/5", "Bag", ["b", "a"], "ACTIVE", None, [("g/V/1", "Default Title", 1.0, "2026-03-01T00:00:00Z"), ("g/V/2", "Red", 2.0, "2026-03-01T00:00:00Z")]), ("g/P/6", "Cap", None, None, None, [])], kind)
    got = clean.snapshot_products(df).orderBy("variant_id").collect()
    assert [(r.variant_id, r.product_id, r.title, r.tags, str(r.created_at)) for r in got] == [(1, 5, "Bag", ["a", "b"], "2026-03-01"), (2, 5, "Bag - Red", ["a", "b"], "2026-03-01")]


def test_profile(spark):
    lines = [(1, date(2026, 1, 1), "pos", None, 1, 1), (2, date(2026, 2, 1), "web", "c1", 1, 1), (2, date(2026, 2, 1), "web", "c1", 2, 2), (3, date(2026, 3, 1), "web", "c1", 3, 1)]
    lines = spark.createDataFrame(lines, "order_id long, date date, source string, customer string, variant_id long, quantity int")
    products = spark.createDataFrame([(1, ["x"]), (2, [])], "variant_id long, tags array<string>")
    got = {r.label: r.value for r in profile.report(lines, products, 28).collect()}
    want = {"orders": 3, "first_date": 20260101, "last_date": 20260301, "months": 3, "multi_item_orders": 1, "customers": 1, "customers_2": 1, "variants_sold": 3, "tag_coverage": 0.5, "cold_share": 2 / 3}
    assert {k: got[k] for k in want} == {k: round(v, 6) for k, v in want.items()} and got["sold_once_share"] == round(2 / 3, 6) and got["sold_in_catalog"] == 2
