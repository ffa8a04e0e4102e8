"""JSON-lines tables."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import strip


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Skips blank lines and lines that begin with ``#``, white space aside."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Keeps fields that are null. Returns the rows written, counted by the job that writes them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]
