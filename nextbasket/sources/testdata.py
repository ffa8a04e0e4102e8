"""Orders, catalog and stock as views of the star-schema tables, in SQL that Spark and DuckDB both read."""

from pyspark.sql import DataFrame, SparkSession

TRAIN_END, VAL_END = "2000-12-31", "2001-04-30"

#: One row a raw order line, with the fields of its order.
RAW = """
select o_orderkey as id, cast(o_orderdate as date) as date, concat(cast(cast(o_orderdate as date) as varchar(10)), 'T', case when o_orderkey % 24 < 10 then '0' else '' end, cast(o_orderkey % 24 as varchar(2)), ':00:00Z') as created_at, o_orderkey % 97 = 0 as test,
  case when o_orderstatus = 'P' and o_orderkey % 10 = 3 then '2001-01-01T00:00:00Z' else '' end as cancelled_at,
  case substr(o_orderpriority, 1, 1) when '2' then 'pos' when '1' then 'web' when '3' then '3890849' when '4' then 'shopify_draft_order' else 'subscription' end as source_name,
  concat('customer', cast(o_custkey as varchar(20)), '@Example.com') as email,
  case when o_orderkey % 3 <> 0 then concat('gid://shopify/Customer/', cast(o_custkey as varchar(20))) end as customer_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) as pos,
  case when l_suppkey % 11 <> 0 then concat('gid://shopify/ProductVariant/', cast(l_partkey as varchar(20))) end as variant_id,
  concat('gid://shopify/Product/', cast(cast(floor(l_partkey / 4) as bigint) as varchar(20))) as product_id,
  case when l_partkey % 89 = 5 then ' Tip ' else concat('Item ', cast(l_partkey as varchar(20))) end as title,
  cast(l_quantity as int) as quantity,
  case when l_returnflag <> 'R' then 0 when l_discount >= 0.08 then cast(l_quantity as int) else cast(floor(l_quantity / 2) as int) end as refunded,
  floor(l_extendedprice * (1 - l_discount) / l_quantity * 10000 + 0.5) / 10000 as unit_price
from lineitem join orders on l_orderkey = o_orderkey
"""
LINES = """
select l_orderkey as order_id, cast(o_orderdate as date) as date,
  case substr(o_orderpriority, 1, 1) when '2' then 'pos' when '1' then 'web' when '3' then 'app' when '4' then 'draft' else 'other' end as source,
  case when o_orderkey % 3 <> 0 then cast(o_custkey as varchar(20)) end as customer, l_partkey as variant_id, cast(l_quantity as int) as quantity
from lineitem join orders on l_orderkey = o_orderkey
where not (l_partkey % 5 = 0 and cast(o_orderdate as date) < date '2000-07-01' + cast((l_partkey * 37) % 395 as int))
"""
PRODUCTS = """
select p_partkey as variant_id, cast(floor(p_partkey / 4) as bigint) as product_id,
  concat(p_name, case p_size % 10 when 0 then ' Exclusive' when 1 then ' Chase' when 2 then ' Glow' when 3 then concat(' #', cast(p_size as varchar(9))) when 4 then ' Comic-Con' else '' end) as title,
  p_brand as tag1, p_type as tag2, split_part(p_name, ' ', 1) as tag3, split_part(p_name, ' ', 2) as tag4, round(p_retailprice - 900, 2) as price,
  case when p_partkey % 5 = 0 then date '2000-07-01' + cast((p_partkey * 37) % 395 as int) else date '1994-06-01' + cast(p_partkey % 900 as int) end as created_at,
  case when p_partkey % 13 = 0 then 'ARCHIVED' when p_partkey % 17 = 0 then 'DRAFT' else 'ACTIVE' end as status,
  case when p_partkey % 7 <> 3 then cast(p_size % 5 as int) end as stock
from part
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over the tables of ``sf_dir``."""
    names = [n for n in ("lineitem", "orders", "part") if n in sql]
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql.replace("from lineitem join orders", "from {lineitem} as lineitem join {orders} as orders").replace("from part", "from {part} as part"), **tables)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LINES)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return view(spark, sf_dir, PRODUCTS).withColumn("tags", F.array("tag1", "tag2", "tag3", "tag4"))


#: The fields of an order and of a line in ``RAW``, of a row that holds the order's columns and its sorted lines ``z``.
HEAD = """
o_orderkey as id, cast(o_orderdate as date) as date, concat(cast(cast(o_orderdate as date) as varchar(10)), 'T', case when o_orderkey % 24 < 10 then '0' else '' end, cast(o_orderkey % 24 as varchar(2)), ':00:00Z') as created_at, o_orderkey % 97 = 0 as test,
case when o_orderstatus = 'P' and o_orderkey % 10 = 3 then '2001-01-01T00:00:00Z' else '' end as cancelled_at,
case substr(o_orderpriority, 1, 1) when '2' then 'pos' when '1' then 'web' when '3' then '3890849' when '4' then 'shopify_draft_order' else 'subscription' end as source_name,
concat('customer', cast(o_custkey as varchar(20)), '@Example.com') as email,
case when o_orderkey % 3 <> 0 then concat('gid://shopify/Customer/', cast(o_custkey as varchar(20))) end as customer_id
"""
LINE_ITEMS = """
transform(z, (x, i) -> named_struct('pos', i + 1, 'variant_id', case when x.l_suppkey % 11 <> 0 then concat('gid://shopify/ProductVariant/', cast(x.l_partkey as varchar(20))) end,
  'product_id', concat('gid://shopify/Product/', cast(cast(floor(x.l_partkey / 4) as bigint) as varchar(20))), 'title', case when x.l_partkey % 89 = 5 then ' Tip ' else concat('Item ', cast(x.l_partkey as varchar(20))) end,
  'quantity', cast(x.l_quantity as int), 'refunded', case when x.l_returnflag <> 'R' then 0 when x.l_discount >= 0.08 then cast(x.l_quantity as int) else cast(floor(x.l_quantity / 2) as int) end,
  'unit_price', floor(x.l_extendedprice * (1 - x.l_discount) / x.l_quantity * 10000 + 0.5) / 10000)) as line_items
"""


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of ``RAW`` with their lines nested in order of ``pos``.

    The tables' own columns are joined and grouped; texts are made of them afterwards, once an order."""
    from pyspark.sql import functions as F

    line = ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount"]
    head = ["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_custkey"]
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = lines.select("l_orderkey", *line).join(orders.select(*head), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy(*head).agg(F.array_sort(F.collect_list(F.struct(*line))).alias("z"))
    return spark.sql(f"select {HEAD}, {LINE_ITEMS} from {{rows}}", rows=rows)
