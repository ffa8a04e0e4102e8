"""Flat rows out of nested API nodes, without a shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_money


def flatten_orders(nodes: DataFrame) -> DataFrame:
    """Refunded quantities are summed by line over all refunds; a refund without a line is skipped."""
    refunds = F.flatten(F.transform("refunds", lambda r: r["lines"]))

    def line(x):
        own = F.filter(refunds, lambda r: r["line_id"] == x["id"])
        total = F.aggregate(own, F.lit(0), lambda a, r: a + F.coalesce(r["quantity"], F.lit(0)))
        return F.struct(
            x["id"].alias("id"), x["title"].alias("title"), x["quantity"].alias("quantity"), x["variant_id"].alias("variant_id"),
            parse_money(x["amount"]).alias("unit_price"), total.alias("refunded_quantity"),
        )

    return nodes.withColumn("line_items", F.transform("lines", line)).drop("refunds", "lines")


def flatten_products(nodes: DataFrame) -> DataFrame:
    """Products with ``variants[]``; null tags become empty."""
    variants = F.transform("variants", lambda v: F.struct(v["id"].alias("id"), v["title"].alias("title"), parse_money(v["price"]).alias("price")))
    return nodes.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "variants": variants})


def flatten_inventory(nodes: DataFrame) -> DataFrame:
    """On-hand quantity by variant; the last pull wins, null counts as 0."""
    number = F.substring_index("id", "/", -1).cast("bigint").alias("variant_id")
    return nodes.groupBy(number).agg(F.coalesce(F.max_by("quantity", "pulled_at"), F.lit(0)).alias("quantity"))
