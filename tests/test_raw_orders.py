"""The nested raw orders of the adapter."""

from pyspark.sql import functions as F

from nextbasket.sources import testdata


def test_texts_are_made_after_grouping(spark):
    sf = "/root/testdata/sf0.001"
    rows = testdata.raw_orders(spark, sf)
    flat = rows.select("id", "date", "created_at", "test", "cancelled_at", "source_name", "email", "customer_id", F.inline("line_items"))
    want = testdata.view(spark, sf, testdata.RAW).select(*flat.columns)
    assert flat.dtypes == want.dtypes and flat.count() == want.count() > 1000
    assert flat.exceptAll(want).isEmpty() and want.exceptAll(flat).isEmpty()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "gid://" in plan and "gid://" not in plan[plan.index("\n", plan.index("Aggregate")) :]
