"""URL filters: allow and block rules, and gradient-boosted trees on lexical features.

The trees are fitted on labelled URLs (1 for block) and judge those that no rule fits. Histograms
of gradients are summed by Spark, one small aggregation a level; the fitted trees become CASE
expressions, so scoring is a projection. A part of the labelled rows is held out: there the area
under the ROC curve is taken, and the least score to block is that with the largest difference of
true and false positive rates. If the area is not above one half by two standard errors, the
labels do not follow the URLs and the trees block nothing. The statistics of a suffix (the
host's last two labels) are counted over all pages, for training and scoring alike. Main path:
built-in DataFrame functions.

Null urls and those without ``://`` have empty host and path, and get verdict ``allow`` or
``block`` from the trees like any other. Without labelled URLs, or with one label only, the
model is a constant. Other columns are ignored; repeated rows each get their own result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, written

# Verdict and rule, in which the host ends at the first slash.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "host_parts", "hyphens", "suffix_share"]

#: Rows of the labelled sample in expectation; trees, levels of a tree, bins, step, leaf penalty.
SAMPLE_ROWS, TREES, DEPTH, BINS, STEP, PENALTY = 20_000, 12, 3, 16, 0.3, 1.0
#: One in so many labelled rows is held out; buckets of held-out scores.
HELD_OUT, BUCKETS = 4, 1000


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path})


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits, null if none does."""
    pick, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        pick, verdict = F.when(fits, rule).otherwise(pick), F.when(fits, kind).otherwise(verdict)
    return df.withColumns({"rule": pick, "rule_verdict": verdict})


def suffixes(df: DataFrame) -> DataFrame:
    """``(suffix, suffix_share)``: the share of all rows with each host's last two labels."""
    own = df.groupBy(F.substring_index("host", ".", -2).alias("suffix")).agg(F.count(F.lit(1)).alias("own"))
    return written(own.withColumn("suffix_share", F.col("own") / max(1, df.count())).drop("own"), "suffixes")


def features(df: DataFrame, shares: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features; ``shares`` is that of ``suffixes``, joined by its size as Spark finds best."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))

    def entropy(chars: Column) -> Column:
        size = F.size(chars)
        logs = F.transform(F.array_distinct(chars), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / size)
        return F.aggregate(logs, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    gone = lambda chars: F.length(u) - F.length(F.translate(u, chars, ""))
    df = df.withColumn("suffix", F.substring_index("host", ".", -2))
    df = df.join(shares, "suffix", "left")
    return df.withColumns({
        "length": F.length(u).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": gone("0123456789") / n,
        "entropy": F.round(F.when(F.length(u) > 0, let(F.filter(F.split(u, ""), lambda c: c != ""), entropy)).otherwise(0.0), 6),
        "params": F.when(u.contains("?"), gone("&=") - gone("=") + 1).otherwise(0).cast("double"),
        "host_parts": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": gone("-").cast("double"),
        "suffix_share": F.coalesce("suffix_share", F.lit(0.0)),
    })


def edges_of(sample: DataFrame) -> dict[str, list[float]]:
    """Bin edges of each feature: distinct quantiles."""
    q = [k / BINS for k in range(1, BINS)]
    row = sample.agg(*[F.percentile_approx(f, q).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(row[f] or [])) for f in FEATURES}


def roc(counts: list[tuple[int, int, int]]) -> dict:
    """Area under the ROC curve with its standard error, base rate, and the best least score, from ``(bucket, good, bad)``."""
    good, bad = sum(g for _, g, _ in counts), sum(b for _, _, b in counts)
    area, over, best, cut = 0.0, 0, 0.0, 2.0
    above_good = above_bad = 0
    for bucket, g, b in sorted(counts, reverse=True):
        area += b * (good - above_good - g / 2)
        above_good, above_bad = above_good + g, above_bad + b
        gain = above_bad / max(1, bad) - above_good / max(1, good)
        if gain > best:
            best, cut, over = gain, bucket / BUCKETS, above_good
    auc = area / (good * bad) if good and bad else 0.5
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    error = math.sqrt(max(0.0, auc * (1 - auc) + (bad - 1) * (q1 - auc * auc) + (good - 1) * (q2 - auc * auc)) / (good * bad)) if good and bad else 1.0
    return {"auc": auc, "error": error, "base_rate": bad / max(1, good + bad), "rows": good + bad, "cut": cut, "false_blocks": over}


def evaluated(rows: DataFrame, margin: str) -> dict:
    """``roc`` of labelled rows; the driver sees at most ``BUCKETS`` + 1 counts."""
    bucket = F.floor(F.expr(f"1 / (1 + exp(-({margin})))") * BUCKETS).alias("bucket")
    counts = rows.groupBy(bucket).agg(F.count_if(F.col("label") == 0).alias("good"), F.count_if(F.col("label") == 1).alias("bad")).collect()
    return roc([(r.bucket, r.good, r.bad) for r in counts])


def held() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(5)), F.lit(HELD_OUT)) == 0


def least_score(found: dict) -> float:
    """The least score to block; over 1 where the labels do not follow the URLs."""
    return found["cut"] if found["auc"] - 2 * found["error"] > 0.5 else 2.0


def bins(edges: dict[str, list[float]]) -> Column:
    """The bin of each feature, in the order of ``FEATURES``: how many of its edges it reaches."""
    reached = [" + ".join(["0", *(f"if({f} >= {x!r}D, 1, 0)" for x in edges[f])]) for f in FEATURES]
    return F.expr(f"array({', '.join(reached)})")


def best_split(cells: list, edges: dict[str, list[float]]) -> tuple:
    """``(gain, feature, edge, g and h below it, g and h from it on)`` of a node, from its sums ``(f, bin, g, h)``."""
    worth = lambda g, h: g * g / (h + PENALTY)
    best = (0.0, "", 0.0, 0.0, 0.0, 0.0, 0.0)
    for f, name in enumerate(FEATURES):
        own = {r.bin: (r.g, r.h) for r in cells if r.f == f}
        g, h = (sum(v[k] for v in own.values()) for k in (0, 1))
        gl = hl = 0.0
        for k, x in enumerate(edges[name]):
            gl, hl = gl + own.get(k, (0.0, 0.0))[0], hl + own.get(k, (0.0, 0.0))[1]
            # rounded, so that the order of a sum does not choose among equal splits
            gain = round(worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h), 9)
            best = max(best, (gain, name, x, gl, hl, g - gl, h - hl))
    return best


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> str:
    """A SQL expression for the margin of ``block`` over the feature columns.

    ``labelled`` has the features and ``label``. About ``sample_rows`` rows are used, picked by
    hash. The driver sees a histogram a level: nodes x features x bins sums.
    """
    n = labelled.count()
    part = max(1, min(1_000_000, math.ceil(1_000_000 * sample_rows / max(1, n))))
    pick = F.pmod(F.xxhash64("url", "length", "entropy"), F.lit(1_000_000)) < part
    sample = written(labelled.where(pick).select(F.col("label").cast("double").alias("label"), *FEATURES).coalesce(1), "url-sample")
    row = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    n, p = row.n, row.p or 0.0
    start = math.log((p + 0.5) / (n - p + 0.5))
    margin = f"{start!r}D"
    if not n or p in (0, n):
        return margin
    edges = edges_of(sample)
    sample = written(sample.withColumns({"bins": bins(edges), "margin": F.lit(start)}).coalesce(1), "url-sample")
    prob = "1 / (1 + exp(-margin))"
    leaf = lambda cond, g, h: f"when {cond} then {STEP * g / (h + PENALTY)!r}D"
    for _ in range(trees):
        nodes: list[tuple] = [("true", 0.0, 0.0)]
        leaves: list[str] = []
        for _ in range(depth):
            if not nodes:
                break
            where = "case " + " ".join(f"when {c} then {k}" for k, (c, _, _) in enumerate(nodes)) + " end"
            got = (
                sample.withColumns({"node": F.expr(where), "g": F.expr(f"label - {prob}"), "h": F.expr(f"({prob}) * (1 - {prob})")})
                .where("node is not null")
                .select("node", "g", "h", F.posexplode("bins").alias("f", "bin"))
                .groupBy("node", "f", "bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .collect()
            )
            after: list[tuple] = []
            for k, (cond, _, _) in enumerate(nodes):
                cells = [r for r in got if r.node == k]
                gain, f, x, gl, hl, gr, hr = best_split(cells, edges)
                if gain > 0:
                    after += [(f"{cond} and {f} < {x!r}D", gl, hl), (f"{cond} and not {f} < {x!r}D", gr, hr)]
                else:
                    leaves.append(leaf(cond, *(sum(c[k] for c in cells if c.f == 0) for k in ("g", "h"))))
            nodes = after
        leaves += [leaf(*node) for node in nodes]
        tree = "case " + " ".join(leaves) + " else 0D end"
        margin += f" + {tree}"
        # written, so that the plans of later trees stay small
        sample = written(sample.withColumn("margin", F.expr(f"margin + {tree}")).coalesce(1), "url-sample")
    return margin


def trained(rows: DataFrame) -> tuple[str, dict]:
    """The margin fitted on the rows that are not held out, and its figures on those that are.

    If either part has no row of one label, all rows serve for both."""
    kinds = {(r.part, r.label) for r in rows.select(held().alias("part"), "label").distinct().collect()}  # four at most
    if len(kinds) < 4:
        margin = fit(rows)
        return margin, evaluated(rows, margin)
    margin = fit(rows.where(~held()))
    return margin, evaluated(rows.where(held()), margin)


def judged(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, score (probability of ``block``) and verdict.

    ``labelled(url, label)`` trains the trees; without it, the URLs that a rule decides do."""
    rows = ruled(parsed(pages), rules)
    shares = suffixes(rows)
    rows = features(rows, shares)
    if labelled is None:
        known = rows.where("rule is not null").withColumn("label", F.expr("if(rule_verdict = 'block', 1, 0)"))
    else:
        known = features(ruled(parsed(labelled), rules), shares)
    margin, found = trained(written(known.select("url", "label", *FEATURES), "labelled-urls"))
    rows = rows.withColumn("score", F.expr(f"1 / (1 + exp(-({margin})))"))
    return rows.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("score") >= least_score(found), "block").otherwise("allow")))


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled are the URLs whose number names a row of ``labels``: low quality or toxic is 1."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("pages", "labels"))
    bad = labels.groupBy("doc_id").agg(F.max(F.expr("if(quality = 0 or toxic = 1, 1, 0)")).alias("label"))
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]{1,18})([.?#/].*)?$', 1) as bigint)")
    return pages.withColumn("doc_id", number).join(bad, "doc_id").select("url", "label")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, labelled=labelled_urls(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


QUERIES = {"op4_urls": op4_urls}
ORACLES: dict[str, str] = {}
