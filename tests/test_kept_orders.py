"""The orders that cleaning keeps, found without nesting their lines."""

from pyspark.sql import functions as F

from nextbasket.operators import clean

HEAD = "id long, created_at string, test boolean, cancelled_at string, source_name string, email string, customer_id string"
LINE = "pos int, variant_id string, product_id string, title string, quantity int, refunded int, unit_price double"


def test_kept_orders_equal_cleaned_ones(spark):
    good, gone = (1, "v1", "p1", "Item", 2, 0, 1.0), [(1, "v1", "p1", " Tip ", 1, 0, 1.0), (2, None, "p1", "Item", 1, 0, 1.0), (3, "v2", "p1", "Item", 2, 2, 1.0), (4, "", "p1", "Item", 2, None, 1.0)]
    head = lambda i, test=False, cancelled="", email="a@b.c": (i, f"2026-01-0{i}T00:00:00Z", test, cancelled, "web", email, None)
    orders = [(*head(1), [good, *gone]), (*head(2), gone), (*head(3, test=True), [good]), (*head(4, cancelled="x"), [good]), (*head(5, email="ME@b.c"), [good]), (*head(6, cancelled=None), [good, good])]
    # two orders of one id: what one keeps keeps both, as in the join by id
    orders += [(*head(7), [good]), (*head(7, test=True), [good])]
    nested = spark.createDataFrame(orders, f"{HEAD}, line_items array<struct<{LINE.replace(' ', ':').replace(',:', ', ')}>>")
    flat = nested.select("*", F.inline("line_items")).drop("line_items")
    rows = clean.kept_orders(flat, ["me@B.c"])
    want = clean.clean_orders(nested, ["me@B.c"]).select("id", "created_at")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect())) and sorted(r.id for r in rows.collect()) == [1, 6, 7, 7]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
