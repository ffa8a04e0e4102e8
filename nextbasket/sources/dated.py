"""Tables in folders by month, of which a scan of the last days reads the last folders only."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dated(df: DataFrame, path: str, date: str = "date") -> None:
    """Partitioned by the month of ``date``; rows without a date go to a folder of their own."""
    month = F.date_format(date, "yyyy-MM")
    # a month's rows lie together, so that a task does not open a file for each
    df.withColumn("month", month).repartition("month", F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("overwrite").partitionBy("month").parquet(path)


def read_since_last(spark: SparkSession, path: str, days: int, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days before the latest one, that day included.

    The latest day is looked for in the last month only, and the months before the first day are never read."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    last = rows.agg(F.max(F.col("month").cast("string")).alias("m")).first().m  # from the folders' names
    if last is None:
        return rows.where(F.lit(False)).drop("month")
    end = rows.where(F.col("month").cast("string") == last).agg(F.max(date).alias("d")).first().d
    start = F.date_sub(F.lit(end), days)
    first = spark.range(1).select(F.date_format(start, "yyyy-MM").alias("m")).first().m
    return rows.where((F.col("month") >= first) & (F.col(date) >= start)).drop("month")
