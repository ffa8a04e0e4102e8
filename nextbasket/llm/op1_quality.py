"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger holds the measurements and
one bit a failed rule; versioned policies are masks over those bits, so a new policy or
an ablation reads the ledger only, never the texts.

Main path: built-in DataFrame functions. Windows are compared by 64-bit hashes inside a
document. Null text: no words, all measurements 0. Any other columns are ignored;
repeated rows each get their own result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words_of, written

WINDOW = 8

# Name of the rule and the condition under which a document fails it.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("shouting", "100 * n_upper > 60 * word_chars"),
    ("many_marks", "100 * n_marks > 50 * n_words"),
    ("many_digits", "100 * n_digits > 50 * word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that a document must not fail.
POLICIES = {
    "base-1": ["few_words", "repeated_windows"],
    "full-1": [name for name, _ in RULES],
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of the text found twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.when(k == 0, window).otherwise(F.least(F.lit(window), x - at[k - 1])))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        """Starts of windows that have an equal neighbour in hash order."""
        same = F.filter(
            pairs,
            lambda e, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == e["h"])) | F.coalesce(F.get(pairs, k + 1)["h"] == e["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(pairs, places), covered))

    def doubled(step: int):
        """From hashes of windows to those of windows twice as long, of two ``step`` apart."""

        def body(hashes: Column) -> Column:
            n = F.size(hashes) - step
            return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda x, y: F.xxhash64(x, y))

        return body

    if window & (window - 1):
        raise ValueError("the window is a power of two")
    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < window:
        hashes, step = let(hashes, doubled(step)), 2 * step
    return F.when(F.size(words) < window, 0).otherwise(let(hashes, of)).cast("long")


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: ``key`` and the measurements that the rules read."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = let(
        words_of(t),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("rep")),
    )
    # what is left without the commonest characters is short, so counting in it is cheap
    rare = F.regexp_replace(t, "[a-z ]+", "")
    df = docs.select(F.col(key), rare.alias("t"), word_counts.alias("w"), line_counts.alias("l"))
    return df.select(
        key,
        F.col("w.n").cast("long").alias("n_words"),
        F.col("w.chars").cast("long").alias("word_chars"),
        count_of(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.rep").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"),
        count_of(F.col("t"), UPPER).alias("n_upper"),
        count_of(F.col("t"), "!?").alias("n_marks"),
        count_of(F.col("t"), "0123456789").alias("n_digits"),
    )


def ledger(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements and ``fail_mask``: bit k is set if the document fails rule k."""
    mask = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(rules):
        mask = mask.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text, key).withColumn("fail_mask", mask)


def policy_mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes(policy: str) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: failures, documents that only it drops, documents kept without it.

    One aggregation over the ledger, pre-aggregated by mask."""
    full = policy_mask(policy)
    masks = rows.groupBy(F.col("fail_mask").bitwiseAND(F.lit(full)).alias("m")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[policy]])).alias("r")
    m, bit = F.col("m"), F.col("r.bit")
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)).alias
    return (
        masks.select("m", "count", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(m.bitwiseAND(bit) != 0)("n_failed"),
            total(m == bit)("n_only"),
            total(m.bitwiseAND(F.lit(full).cast("long").bitwiseXOR(bit)) == 0)("n_kept_without"),
        )
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written ledger of ``documents``: what follows reads it, never the texts again."""
    return written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-ledger")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger and verdict of policy ``full-1`` for every document."""
    base = ~passes("base-1")
    return stored(spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes("full-1").alias("kept"), "fail_mask", "n_lines", "n_upper", "n_marks", "n_digits",
    )


def op1_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations of every policy, from one ledger."""
    rows, out = stored(spark, sf_dir), None
    for policy in POLICIES:
        part = ablation(rows, policy).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return out


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') as ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as ls from d),
g as (select r, i, list_slice(ws, i, i + 7) as k from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
rep as (select r, i from (select r, i, count(*) over (partition by r, k) as n from g) where n > 1),
cov as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from rep) group by r),
m as (select doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::bigint as word_chars,
      (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
      (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
      len(ls)::bigint as n_lines,
      (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::bigint as n_upper,
      (length(t) - length(translate(t, '!?', '')))::bigint as n_marks,
      (length(t) - length(translate(t, '0123456789', '')))::bigint as n_digits
      from w left join cov using (r)),
f as (select *, (RULES)::bigint as fail_mask from m)
""".replace("RULES", " + ".join(f"case when {rule} then {1 << k} else 0 end" for k, (_, rule) in enumerate(RULES)))

QUERIES = {"op1_quality": op1_quality, "llm_quality_ablation": op1_ablation}
ORACLES = {
    "op1_quality": ORACLE + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_mask & 3) <> 0 as base_failed, fail_mask = 0 as kept, fail_mask, n_lines, n_upper, n_marks, n_digits from f",
    "llm_quality_ablation": ORACLE
    + ", rules(policy, rule, bit, whole) as (values "
    + ", ".join(f"('{p}', '{n}', {BIT[n]}, {policy_mask(p)})" for p in POLICIES for n in POLICIES[p])
    + ") select policy, rule, sum(case when fail_mask & bit <> 0 then 1 else 0 end)::bigint as n_failed, sum(case when fail_mask & whole = bit then 1 else 0 end)::bigint as n_only, "
    "sum(case when fail_mask & xor(whole, bit) = 0 then 1 else 0 end)::bigint as n_kept_without from f, rules group by policy, rule",
}
