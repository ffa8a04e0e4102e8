"""The table of chosen configurations: selection writes a version, and refit, serving, gates and export read it.

A version is a row a role: ``popularity``, ``attr``, ``content``, ``item`` and ``hybrid``, each with the name of its
model, the column of its score (``sweep``), the column of its prior, and its weight in the blend. Versions are folders that
are never changed; the highest one counts. Without a table the configuration is ``DEFAULT``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of the table, in the session's settings.
FOLDER = "spark.nextbasket.models"
SCHEMA = "role string, model string, score string, prior string, weight double"


@dataclass(frozen=True)
class Config:
    """``popularity`` is a column of shares, ``attr`` and ``item`` are columns of scores; ``weights`` of attr, content, item."""

    popularity: str
    attr: str
    item: str
    weights: tuple[float, float, float]
    tie: float = 1e-6
    label: str = "hybrid"
    #: Names of the chosen models by role, as selection listed them.
    names: tuple[tuple[str, str], ...] = ()

    def blend(self) -> dict[str, tuple[dict[str, float], dict[str, float]]]:
        """The served blend for ``ranker``; parts without a weight drop out."""
        parts = dict(zip(("attr", "content", "item"), self.weights, strict=True))
        return {"hybrid": ({c: w for c, w in parts.items() if w > 0}, {"u": self.tie})}

    def least(self) -> int:
        """The least count of an attribute pair."""
        return int(self.attr.removeprefix("attr"))


#: What is served where nothing was selected.
DEFAULT = Config("u30", "attr5", "cosine5", (1.0, 1.0, 0.5))


def rows_of(spark: SparkSession, c: Config) -> DataFrame:
    names = dict(c.names)
    attr, content, item = c.weights
    data = [
        ("popularity", names.get("popularity"), "0D", c.popularity, None), ("attr", names.get("attr"), c.attr, "0D", attr), ("content", names.get("content"), "content", "0D", content),
        ("item", names.get("item"), c.item, "0D", item), ("hybrid", c.label, None, "u", c.tie),
    ]
    return spark.createDataFrame(data, SCHEMA)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def publish(spark: SparkSession, c: Config, folder: str) -> int:
    """Writes the next version. Of two writers at once one fails, as its folder exists."""
    n = max(versions(spark, folder), default=0) + 1
    rows_of(spark, c).coalesce(1).write.mode("error").parquet(f"{folder}/version={n}")
    return n


def current(spark: SparkSession, folder: str | None = None, version: int | None = None) -> Config:
    """The latest version, or the one asked for."""
    folder = folder or spark.conf.get(FOLDER, None)
    known = versions(spark, folder) if folder else []
    if version is not None and version not in known:
        raise ValueError(f"no version {version}")
    if not known:
        return DEFAULT
    rows = {r.role: r for r in spark.read.schema(SCHEMA).parquet(f"{folder}/version={version or known[-1]}").collect()}  # five rows
    names = tuple((k, rows[k].model) for k in ("popularity", "attr", "content", "item") if rows[k].model)
    return Config(rows["popularity"].prior, rows["attr"].score, rows["item"].score, tuple(rows[k].weight for k in ("attr", "content", "item")), rows["hybrid"].weight, rows["hybrid"].model, names)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All versions: ``(version, role, model, score, prior, weight)``."""
    out = spark.createDataFrame([], "version int, " + SCHEMA)
    for n in versions(spark, folder):
        out = out.unionByName(spark.read.schema(SCHEMA).parquet(f"{folder}/version={n}").withColumn("version", F.lit(n)))
    return out
