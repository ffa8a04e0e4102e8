"""Profile of a snapshot: ``(label, value)`` rows, with exact counts and upper medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """``sorted(x)[n // 2]`` from a frequency table, so that no task sorts all rows."""
    freq = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = freq.select("v", F.sum("n").over(W.orderBy("v")).alias("cum"), F.sum("n").over(W.partitionBy()).alias("total"))
    return run.where(F.col("cum") > F.floor(F.col("total") / 2)).agg(F.min("v").alias("value"))


def per_order(lines: DataFrame) -> DataFrame:
    # an order's variants are made distinct where its lines are joined, without a table of all pairs
    return lines.groupBy("order_id", "date", "source", "customer").agg(F.sum("quantity").alias("units"), F.size(F.collect_set("variant_id")).cast("long").alias("variants"))


def report(lines: DataFrame, products: DataFrame, cold_days: int = 90) -> DataFrame:
    """All figures; shares as numerator over denominator, days as yyyymmdd."""
    o, share = per_order(lines), lambda a, b: F.try_divide(a, b)
    count = lambda c: F.count_if(c)
    basics = o.agg(
        F.count(F.lit(1)).alias("orders"), F.date_format(F.min("date"), "yyyyMMdd").alias("first_date"), F.date_format(F.max("date"), "yyyyMMdd").alias("last_date"), F.countDistinct(F.date_format("date", "yyyy-MM")).alias("months"),
        share(count(F.col("customer").isNotNull()), F.count(F.lit(1))).alias("customer_share"),
        share(count(F.col("customer").isNotNull() & (F.col("source") == "pos")), count(F.col("source") == "pos")).alias("customer_share_pos"),
        count(F.col("variants") >= 2).alias("multi_item_orders"),
    )
    who = o.where("customer is not null").groupBy("customer").agg(F.count(F.lit(1)).alias("n"))
    who = who.agg(F.count(F.lit(1)).alias("customers"), count(F.col("n") >= 2).alias("customers_2"), count(F.col("n") >= 5).alias("customers_5"))
    sold = lines.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("units"), F.min("date").alias("first"))
    once = sold.agg(F.count(F.lit(1)).alias("variants_sold"), share(count(F.col("n") == 1), F.count(F.lit(1))).alias("sold_once_share"))
    top = sold.orderBy(F.desc("units"), "variant_id").limit(20).agg(F.sum("units").alias("t")).join(sold.agg(F.sum("units").alias("u"))).select(share("t", "u").alias("top20_share"))
    end = lines.agg(F.date_sub(F.max("date"), cold_days).alias("start"))
    recent = lines.join(F.broadcast(end), lines["date"] >= F.col("start")).join(sold.select("variant_id", "first"), "variant_id")
    cold = recent.agg(share(count(F.col("first") >= F.col("start")), F.count(F.lit(1))).alias("cold_share"))
    catalog = products.agg(F.count(F.lit(1)).alias("catalog"), share(count(F.size("tags") > 0), F.count(F.lit(1))).alias("tag_coverage"))
    tags = products.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("tags"))
    still = sold.join(products.select("variant_id").distinct(), "variant_id", "left_semi").agg(F.count(F.lit(1)).alias("sold_in_catalog"))
    months = upper_median(o.groupBy(F.date_format("date", "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n")), "n").withColumnRenamed("value", "orders_per_month_median")
    units = upper_median(o, "units").withColumnRenamed("value", "units_median")
    out = None
    for df in (basics, who, once, top, cold, catalog, tags, still, months, units):
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in df.columns])))
        out = rows if out is None else out.union(rows)
    return out


def source_mix(lines: DataFrame) -> DataFrame:
    mix = per_order(lines).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return mix.join(mix.agg(F.sum("n").alias("total"))).select("source", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
