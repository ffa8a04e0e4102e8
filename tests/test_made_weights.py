"""Lists of neighbours hold three counts, whatever the number of configurations; attribute counts are equal with numbers of variants and by a shuffle."""

from datetime import date

import numpy as np

from nextbasket.operators import models, sweep


def test_weights_from_counts_equal_those_of_edges(spark):
    fit = spark.createDataFrame([(k, sorted({k % 7, k % 5 + 3, k % 11})) for k in range(120)], "order_id long, items array<long>")
    names = list(dict.fromkeys(s for s, _ in sweep.edge_models().values() if s != "0D"))
    made, counts = sweep.made_weights(names, fit.count()), {}
    for e in models.counted(fit).collect():
        counts[e.a, e.c] = [float(e.k), float(e.na), float(e.nc)]
    rows = sweep.edge_weights(fit).collect()
    assert len(names) == 11 and len(rows) == len(counts) > 20
    for e in rows:
        got = made.of(*[np.array([x]) for x in counts[e.a, e.c]])
        assert [float(x[0]) for x in got] == [e[n] for n in names]
    prior = spark.createDataFrame([(v, v / 10, 0.0, 0.0, 0.0) for v in range(11)], "variant_id long, u double, u30 double, u90 double, u180 double")
    available = spark.createDataFrame([(v, date(2026, 1, 1)) for v in range(11)], "variant_id long, available_from date")
    edges = sweep.Edges(fit, prior, available, sweep.edge_models())
    assert not set(names) & set(edges.edges.columns) and edges.made.columns == ["k", "na", "nc"]
    assert sweep.made_weights(["n1", "n3"], 0).columns == ["k"]


def test_attribute_counts_with_and_without_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 9]), (3, [4]), (4, [3, 4, 5, None]), (5, [8, 9])], "order_id long, items array<long>")
    toks = spark.createDataFrame([(v, t) for v, ts in {1: "ab", 2: "ab", 3: "c", 4: "ad", 5: "e", 8: "a"}.items() for t in ts], "variant_id long, token string")
    got = []
    for known in (models.KNOWN, 0):
        monkeypatch.setattr(models, "KNOWN", known)
        f = models.attr_counts(rows, toks)
        assert ("Join" in f._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1]) == (known == 0)
        got.append({(x.f, x.g): x.n for x in f.collect()})
    assert got[0] == got[1] and got[0]["a", "b"] == 2 and got[0]["c", "d"] == 1
