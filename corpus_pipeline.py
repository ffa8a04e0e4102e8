"""Documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last keep the columns of documents; other
columns go. Null texts have no language and go in the first stage; an empty table gives no rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextbasket.llm import op2_secrets, op3_jaccard, op6_substring, op8_packing, op9_language
from nextbasket.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text, and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, and those that the model finds unclear."""
    model = op9_language.fit(docs.where(~op9_language.held_out()))
    rows = op9_language.identify(docs.select(*COLUMNS), model)
    return rows.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, and one of rows that repeat its id and text.

    Rows without an id are linked with nothing and stay."""
    parts = op3_jaccard.components(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(written(parts, "kept-ids"), "doc_id", "left_semi")
    again = written(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "repeated-ids")
    if not again.isEmpty():
        one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one)
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated windows; documents of which nothing is left go."""
    rows = op6_substring.deduplicated(docs.select(*COLUMNS))
    return with_text(rows.where("n_removed = 0 or length(text) > 0"), F.col("text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    docs = docs.select(*COLUMNS)
    rows = op2_secrets.scan(docs, op2_secrets.train(docs))
    return with_text(rows, op2_secrets.redact(F.col("text"), F.col("spans")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return op8_packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("secrets", secrets),
    ("packing", packing),
]
#: Language models and packing are beyond SQL; tests/llm/test_pipeline.py holds a small run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
