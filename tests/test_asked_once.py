"""Contexts of equal vectors are weighed and scored once, and those of equal days and targets ranked once; every query has its own list and rank."""

from datetime import date

import numpy as np

from nextbasket.operators import evaluate, models, nearby, ranker


def test_equal_queries_are_asked_once(spark, monkeypatch):
    """Thirty shifted copies of four baskets: as many dense rows as of the four alone; lists and ranks equal plain numpy."""
    copies, n = 30, 12
    r = np.random.default_rng(8)
    weight = {(v, t): float(r.random()) for v in range(n) for t in r.choice(5, 2, replace=False)}
    x = spark.createDataFrame([(v + n * j, f"t{t}", w) for (v, t), w in weight.items() for j in range(copies)], "variant_id long, token string, w double")
    catalog = range(n * copies)
    available = spark.createDataFrame([(v, date(2026, 3, 1 + v // n % 3)) for v in catalog], "variant_id long, available_from date")
    units = {v: float(v % n % 4) / 3 for v in catalog}
    prior = spark.createDataFrame(list(units.items()), "variant_id long, u double")
    baskets = [[0, 1, 2], [3, 4], [5, 6, 7], [8, 9]]
    rows = [(o + 4 * j, date(2026, 3, 3), "pos", [v + n * j for v in b]) for o, b in enumerate(baskets) for j in range(copies)]
    queries = models.loo_queries(spark.createDataFrame(rows, "order_id long, date date, source string, items array<long>"))
    pmi = spark.createDataFrame([("t0", "t1", 9, 0.7), ("t2", "t3", 9, 0.4), ("t4", "t0", 2, 0.9)], "f string, g string, n long, m double")
    fit = spark.createDataFrame([(k, [k % 360, (k * 7 + 3) % 360]) for k in range(900) if k % 360 != (k * 7 + 3) % 360], "order_id long, items array<long>")
    which = {"h": ({"attr": 1.0, "content": 1.0, "item": 0.5}, {"u": 1e-6}), "p": ({}, {"u": 1.0}), "i": ({"item": 1.0}, {})}
    seen, over = [], ranker.Catalog.over
    monkeypatch.setattr(ranker.Catalog, "over", lambda self, asked, names, f, *a: seen.append((f.__name__, asked.count())) or over(self, asked, names, f, *a))

    def found(wide):
        monkeypatch.setattr(ranker, "WIDE", wide)
        profile, items = ranker.profiles(queries, x, pmi, {"attr": 5}), ranker.catalog_rows(x, available, prior)
        item = nearby.gathered(queries, models.itemitem(fit), "sim")
        tops = ranker.with_item(ranker.maxima(queries, profile, items, ["content", "attr"], counts=False), item)
        lists, sparse = {}, {(q.order_id, q.target): (dict(zip(q.item_ids, q.item, strict=True)), q.top_item) for q in item.collect()}
        for q in ranker.best(queries, profile, items, tops, which, item, 5).orderBy("slot").collect():
            lists.setdefault((q.model, q.order_id, q.target), []).append(q.variant_id)
        ranks = {(q.model, *[q[k] for k in evaluate.KEYS]): (q["rank"], q.n_scored) for q in ranker.ranks(queries, profile, items, tops, prior, which, item).collect()}
        return profile.rows.count(), lists, ranks, sparse

    got, again = found(2048), found(0)
    assert got == again and len(got[2]) == 3 * 10 * copies
    n_profiles, lists, ranks, sparse = got
    assert n_profiles == 10 and dict(seen)["one"] == 10 and min(c for f, c in seen if f == "own") == 10 * copies
    assert [c for f, c in seen if f == "dense"][0] == 10
    tokens = {v: {t: w for (k, t), w in weight.items() if k == v % n} for v in catalog}
    for q in queries.collect():
        c = {t: sum(tokens[v].get(t, 0.0) for v in q.context) for t in range(5)}
        a = {1: c[0] * 0.7, 3: c[2] * 0.4}
        raw = {"content": [sum(c[t] * w for t, w in tokens[v].items()) for v in catalog], "attr": [sum(a.get(t, 0.0) * w for t, w in tokens[v].items()) for v in catalog]}
        own, top = sparse.get((q.order_id, q.target), ({}, 1.0))
        part = {k: np.array(s) / (max(s) or 1.0) for k, s in raw.items()} | {"item": np.array([own.get(v, 0.0) for v in catalog]) / top}
        ok = [v for v in catalog if v not in q.context]
        for m, (ws, ps) in which.items():
            s = sum((w * part[k] for k, w in ws.items()), np.zeros(len(catalog))) + sum((w * np.array([units[v] for v in catalog]) for w in ps.values()), np.zeros(len(catalog)))
            assert lists[m, q.order_id, q.target] == sorted(ok, key=lambda v: (-np.floor(s[v] * 1e10 + 0.5), v))[:5]  # noqa: B023
            key = np.floor(s * 1e12 + 0.5)
            above, same = sum(key[v] > key[q.target] for v in ok), sum(key[v] == key[q.target] for v in ok)
            assert ranks[m, q.order_id, q.target] == (above + 1 + (same - 1) / 2, sum(key[v] > 0 for v in ok))
