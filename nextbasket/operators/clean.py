"""Order and line rules, merging, accounting; anonymizing and auditing the snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coarse_source, gid_number, hash_customer, order_day, strip
from ..sources.scratch import written

# A title that is no product, the public columns, and the title of a product's only variant.
TITLES = ["tip"]
COLUMNS = ["order_id", "date", "source", "customer", "items"]
ITEM_COLUMNS = ["variant_id", "product_id", "title", "quantity", "unit_price"]
PRODUCT_COLUMNS = ["variant_id", "product_id", "title", "tags", "price", "created_at", "status", "image_url"]
ONLY_VARIANT = ["", "Default Title"]


def order_reason(orders: DataFrame, emails: list[str]) -> DataFrame:
    """Adds ``reason``: the first order rule that drops it, or null."""
    reason = (
        F.when(F.col("test"), "dropped_test_order")
        .when(F.nullif("cancelled_at", F.lit("")).isNotNull(), "dropped_cancelled_order")
        .when(F.lower(F.coalesce("email", F.lit(""))).isin([e.lower() for e in emails]), "dropped_excluded_email_order")
    )
    return orders.withColumn("reason", reason)


def line_reason(lines: DataFrame, titles: list[str] = TITLES) -> DataFrame:
    """Adds ``reason`` and the net quantity ``qty`` to exploded lines."""
    qty = F.col("quantity") - F.coalesce("refunded", F.lit(0))
    reason = (
        F.when(F.nullif("variant_id", F.lit("")).isNull(), "dropped_line_no_variant")
        .when(F.lower(strip(F.coalesce("title", F.lit("")))).isin(titles), "dropped_line_blocklisted_title")
        .when(qty <= 0, "dropped_line_fully_refunded")
    )
    return lines.withColumns({"qty": qty, "reason": reason})


def tagged(orders: DataFrame, emails: list[str]) -> DataFrame:
    """Lines of the orders that pass the order rules, with their reasons."""
    kept = order_reason(orders, emails).where("reason is null").drop("reason")
    return line_reason(kept.select("*", F.inline_outer("line_items")).drop("line_items"))


def merged(lines: DataFrame) -> DataFrame:
    """One row for each order and variant: the first line's attributes, the summed quantity."""
    first = F.min_by(F.struct("title", "unit_price", "product_id"), "pos")
    out = lines.where("reason is null").groupBy("id", "variant_id").agg(first.alias("f"), F.sum("qty").alias("quantity"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    return out.select("id", "variant_id", "f.title", "f.unit_price", "f.product_id", "quantity", "pos", "n")


def clean_orders(orders: DataFrame, emails: list[str]) -> DataFrame:
    """Orders with a line left, their lines in first-seen order."""
    item = F.struct("pos", "variant_id", "product_id", "title", "quantity", "unit_price")
    items = merged(tagged(orders, emails)).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return orders.drop("line_items").join(items, "id")


HEAD = ["id", "created_at", "test", "cancelled_at", "source_name", "email", "customer_id"]


def kept_orders(lines: DataFrame, emails: list[str]) -> DataFrame:
    """``(id, created_at)`` of the orders of ``clean_orders``, from raw lines that carry the fields of their order.

    Lines are only looked at one by one: none are nested, merged or sorted."""
    rows = line_reason(order_reason(lines, emails).withColumnRenamed("reason", "why"))
    heads = rows.groupBy(*HEAD).agg(F.max(F.col("why").isNull() & F.col("reason").isNull()).alias("ok"))
    return heads.withColumn("ok", F.max("ok").over(W.partitionBy("id"))).where("ok").select("id", "created_at")


ORDER_RULES = ["dropped_test_order", "dropped_cancelled_order", "dropped_excluded_email_order"]
LINE_RULES = ["dropped_line_no_variant", "dropped_line_blocklisted_title", "dropped_line_fully_refunded"]


def clean_stats(orders: DataFrame, emails: list[str]) -> DataFrame:
    """``(rule, n)`` of the rules that fired, in one pass: each order's lines are counted by variant, then by order, then all."""
    item = F.transform("line_items", lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "variant_id", "title", "quantity", "refunded")]))
    rows = order_reason(orders, emails).select("id", F.col("reason").alias("why"), F.posexplode_outer(item).alias("at", "x"))
    rows = line_reason(rows.select("id", "why", F.coalesce(F.col("at") == 0, F.lit(True)).alias("head"), "x.*"))
    kept, head = F.col("why").isNull(), F.col("head")
    line, ok = kept & F.col("pos").isNotNull(), kept & F.col("reason").isNull()
    sums = {
        "orders_in": head, **{r: head & (F.col("why") == r) for r in ORDER_RULES}, "lines_in": line, **{r: line & (F.col("reason") == r) for r in LINE_RULES},
        "lines_partially_refunded": ok & (F.col("qty") < F.col("quantity")),
    }
    by_variant = rows.groupBy("id", "variant_id").agg(*[F.count_if(c).alias(n) for n, c in sums.items()], F.count_if(ok).alias("ok"), F.max(kept).alias("kept"))
    total = [F.sum(n).alias(n) for n in sums]
    by_order = by_variant.groupBy("id").agg(*total, F.sum(F.greatest(F.col("ok") - 1, F.lit(0))).alias("merged"), F.count_if(F.col("ok") > 0).alias("out"), F.max("kept").alias("kept"))
    row = by_order.agg(
        *total, F.sum("merged").alias("lines_merged_duplicate_variant"), F.sum("out").alias("lines_out"),
        F.count_if(F.col("kept") & ((F.col("out") == 0) | F.col("id").isNull())).alias("dropped_order_no_lines_left"), F.count_if(F.col("out") > 0).alias("orders_out"),
    )
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in row.columns]))).where("n > 0")


def identity(stats: DataFrame) -> DataFrame:
    """Do the counts add up? One row a unit."""
    total = lambda pattern: F.coalesce(F.sum(F.when(F.col("rule").rlike(pattern), F.col("n"))), F.lit(0))
    row = stats.agg(
        total("^orders_in$").alias("oi"), total("^orders_out$|^dropped_.*order").alias("oo"),
        total("^lines_in$").alias("li"), total("^lines_out$|^dropped_line|^lines_merged").alias("lo"),
    )
    return row.select(F.inline(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(a).alias("n_in"), F.col(b).alias("n_accounted"), (F.col(a) == F.col(b)).alias("holds")) for u, a, b in (("orders", "oi", "oo"), ("lines", "li", "lo"))])))


def sequential_ids(orders: DataFrame, by: list[str], name: str = "order_id") -> DataFrame:
    """1..N in order of ``by`` without a single-task window: ranges, and the rows before each."""
    rows = orders.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = rows.withColumn("__m", F.monotonically_increasing_id())
    # written once: a second run could be dealt to other partitions
    rows = written(rows.withColumns({"__p": F.shiftright("__m", 33), "__k": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = {r[0]: r[1] for r in rows.groupBy("__p").count().collect()}  # one row a partition
    before, pairs = 0, []
    for p in sorted(sizes):
        pairs += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += sizes[p]
    if not pairs:
        return orders.withColumn(name, F.lit(0).cast("long"))
    return rows.withColumn(name, F.create_map(*pairs)[F.col("__p")] + F.col("__k") + 1).drop("__m", "__p", "__k")


def anonymize(orders: DataFrame, salt: bytes) -> DataFrame:
    """The public columns only; ids follow the time of creation, then the raw id."""
    items = F.transform("items", lambda i: F.struct(gid_number(i["variant_id"]).alias("variant_id"), gid_number(i["product_id"]).alias("product_id"), i["title"].alias("title"), i["quantity"].alias("quantity"), i["unit_price"].alias("unit_price")))
    return sequential_ids(orders, ["created_at", "id"]).select(
        "order_id", order_day(F.col("created_at")).alias("date"), coarse_source(F.col("source_name")).alias("source"), hash_customer(F.col("customer_id"), salt).alias("customer"), items.alias("items")
    )


def snapshot_products(products: DataFrame) -> DataFrame:
    """A row a variant of products with ``variants[]``: its title behind the product's, tags in order."""
    rows = products.select("*", F.inline("variants").alias("v_id", "v_title", "v_price", "v_created")).drop("variants")
    title = F.when(F.col("v_title").isin(ONLY_VARIANT), F.col("title")).otherwise(F.concat("title", F.lit(" - "), "v_title"))
    return rows.select(
        gid_number(F.col("v_id")).alias("variant_id"), gid_number(F.col("id")).alias("product_id"), title.alias("title"),
        F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), F.col("v_price").alias("price"),
        order_day(F.col("v_created")).alias("created_at"), "status", "image_url",
    )


EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"


def holds_email(text: Column) -> Column:
    """Texts without an at sign, nearly all, are not searched by the pattern."""
    return text.contains("@") & text.rlike(EMAIL)


def violations(rows: DataFrame, other: int, rules: dict[str, Column]) -> DataFrame:
    """``(rule, violations)``: rows for which a rule isn't true; null counts as a violation. ``columns`` is ``other``."""
    row = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    each = [F.struct(F.lit("columns").alias("rule"), F.lit(other).cast("long").alias("violations"))]
    return row.select(F.inline(F.array(*each, *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def audit(snapshot: DataFrame) -> DataFrame:
    """``(rule, violations)`` of an anonymized snapshot; ``columns`` counts those outside the public lists, and those missing.

    Only ``customer`` may be null."""
    inner = snapshot.schema["items"].dataType.elementType.names if "items" in snapshot.columns else []
    other = len(set(snapshot.columns) ^ set(COLUMNS)) + len(set(inner) ^ set(ITEM_COLUMNS))
    return violations(snapshot, other, {
        "source": F.col("source").isin("pos", "web", "app", "draft", "other"),
        "customer": F.col("customer").isNull() | F.col("customer").rlike("^[0-9a-f]{16}$"),
        "items": F.size("items") > 0,
        "variant": F.forall("items", lambda i: i["variant_id"].isNotNull()),
        "quantity": F.forall("items", lambda i: F.coalesce(i["quantity"] >= 1, F.lit(False))),
        "email": ~holds_email(F.to_json(F.struct("*"))),
        "date": F.col("date").isNotNull(),
    })


def audit_products(products: DataFrame) -> DataFrame:
    """``(rule, violations)`` of the public catalog: its columns, and no address in any of them."""
    return violations(products, len(set(products.columns) ^ set(PRODUCT_COLUMNS)), {"variant": F.col("variant_id").isNotNull(), "email": ~holds_email(F.to_json(F.struct("*")))})


def audit_sequence(snapshot: DataFrame) -> DataFrame:
    """Gap-free ids from 1, and dates that never go back: each id is compared with the one before it by a join."""
    counts = snapshot.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("order_id").alias("d"), F.min("order_id").alias("a"), F.max("order_id").alias("b"))
    prev = snapshot.select((F.col("order_id") + 1).alias("order_id"), F.col("date").alias("before"))
    back = snapshot.join(prev, "order_id").agg(F.count_if(F.col("before") > F.col("date")).alias("dates_back"))
    gap = counts.select(((F.col("n") == F.col("d")) & (F.col("a") == 1) & (F.col("b") == F.col("n"))).alias("gap_free"))
    return gap.join(back)
