"""Variants of an order are counted without a table of all pairs of order and variant."""

import re
from datetime import date

from nextbasket.operators import profile


def test_variants_of_an_order_hold_no_pairs(spark):
    d = date(2026, 1, 1)
    lines = spark.createDataFrame([(1, d, "pos", "a", 5, 1), (1, d, "pos", "a", 5, 2), (1, d, "pos", "a", None, 1), (2, d, "web", None, None, 4)], "order_id long, date date, source string, customer string, variant_id long, quantity int")
    out = profile.per_order(lines)
    assert sorted((r.order_id, r.units, r.variants) for r in out.collect()) == [(1, 4, 1), (2, 4, 0)]
    assert not re.search(r"keys=\[[^\]]*variant_id", out._jdf.queryExecution().executedPlan().toString())
