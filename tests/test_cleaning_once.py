"""The account of the cleaning, in one pass."""

from nextbasket.operators import clean
from test_operators import orders


def test_stats_read_the_orders_once(spark, tmp_path):
    line = lambda p, v, title="Thing", q=1, back=0: (p, v, title, q, back, 5.0)
    df = orders(
        spark, (False, "", "a@example.com", [line(1, "v1", q=3, back=1), line(2, "v1"), line(3, None), line(4, "v2", " Tip ")]), (True, "", "a@example.com", [line(1, "v1")]),
        (False, "", "Owner@example.com", []), (False, "", None, [line(1, "v1", back=1)]), (False, "", None, []), (False, "2026-01-05", None, [line(1, "v3")]),
    )
    df.write.parquet(str(tmp_path / "o"))
    rows = clean.clean_stats(spark.read.parquet(str(tmp_path / "o")), ["owner@example.com"])
    assert {r.rule: r.n for r in rows.collect()} == {
        "orders_in": 6, "dropped_test_order": 1, "dropped_cancelled_order": 1, "dropped_excluded_email_order": 1, "lines_in": 5, "dropped_line_no_variant": 1,
        "dropped_line_blocklisted_title": 1, "dropped_line_fully_refunded": 1, "lines_partially_refunded": 1, "lines_merged_duplicate_variant": 1, "lines_out": 1,
        "dropped_order_no_lines_left": 2, "orders_out": 1,
    }
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_only_texts_with_an_at_sign_meet_the_pattern(spark):
    df = spark.createDataFrame([("a@b.org",), ("a@b",), ("none",), (None,)], "t string")
    rows = df.select(clean.holds_email(df.t).alias("e"))
    assert [r.e for r in rows.collect()] == [True, False, False, None]
    assert "Contains" in rows._jdf.queryExecution().optimizedPlan().toString()
