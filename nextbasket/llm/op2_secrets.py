"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Both models are first-order over the characters of tokens, trained from labelled samples. Random
are the values that the fixed patterns found, and strings generated by hashes in the usual
alphabets (base 64, base 62, hexadecimal in both cases, letters, digits). Identifiers are ordinary
words of the sampled texts, alone and joined as programs join them, with numbers, numbers with
separators, rules of one character, and runs of the alphabet, the digits and the keys of a keyboard. A part of the sample is held out: on it the least log ratio a character is chosen
that makes the fewest errors, a harmless token counting ``COST`` times a missed secret. A token
that reaches it on average is a span of kind ``markov``. Numbers are identifiers, so a random string of
digits alone is mostly left. One without digits is scored in lower
case, as identifiers in capitals are rare in texts. Main path: built-in DataFrame functions.

Null text counts as empty: no spans. Spans are in code points, end exclusive. Other columns
are ignored, repeated rows each get their own result, an empty table gives no rows. Without
a text to sample nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, written

# Kind, pattern, group that is the secret, least length of that group, and
# what a text must hold for the pattern to match at all (in lower case; none: no test).
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}+", 0, 20),
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
]
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
MARKOV = ("markov", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+", 0, 16)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RANK = {k: n for n, (k, *_) in enumerate([*KINDS, MARKOV])}

# Words that programs are made of, for the sample of identifiers.
PROGRAM_WORDS = """access account action adapter address api app application array async base body buffer builder button cache callback
client code color column com command common component config connection container content context controller copy count create
current data database date default delete device display document domain download email enable engine error event example export
factory feature field file filter folder format function get group handler header height host http https id image import index info
input insert interface internal international item job key label language layout length level library limit line link list load
local location log login manager map max message method min mode model module name network node notification number object option
order org output package page parameter parent parser path payment permission platform plugin port position preview primary private
process product profile project property protocol provider proxy public query queue random reader record register remote render
report repository request resource response result role root route scale schedule schema screen script search section select sender
server service session set setting size sort source stack start state status storage stream string style submit summary support sync
system table tag target task template test text thread time title token tool total transaction type update upload url user util
validation value version very video view warning web width window word worker writer""".split()

# Characters that rules are drawn with, and runs that people type.
RULES = ["-", "_", "=", "/", "+", "x", "0"]
RUNS = ["abcdefghijklmnopqrstuvwxyz", "1234567890", "qwertyuiopasdfghjklzxcvbnm", "0123456789"]

#: Rows of the labelled sample in expectation, and what a token must score above the threshold a character.
SAMPLE_ROWS = 20_000
MIN_RATIO = 0.0
#: One in so many tokens is held out; errors on identifiers count so often; steps of the threshold.
HELD_OUT, COST, STEPS = 4, 20, 20
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches, then those whose group is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def place(f: Column) -> Column:
        before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["b"]
            e = s + F.length(x["f"])
            span = F.struct(s.alias("start"), F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), x["v"].alias("value"))
            return F.struct(e.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        rows = F.arrays_zip(f.alias("f"), values.alias("v"), F.slice(before, 1, F.size(f)).alias("b"))
        return F.aggregate(rows, start, add)["out"]

    return F.when(F.size(found) > 0, let(found, place)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    low = F.lower(text)
    may = F.lit(False)
    for word in KEYWORDS:
        may = may | low.contains(word)
    none = F.array().cast(f"array<{SPAN}>")
    assign, access, hexa = (matches(text, *k) for k in KINDS)
    return F.sort_array(F.concat(F.when(may, assign).otherwise(none), F.when(text.contains("AKIA"), access).otherwise(none), hexa))


def score(token: Column, ratios: Column) -> Column:
    """Sum of the log ratios of a token's transitions."""

    def of(ids: Column) -> Column:
        n = F.size(ids)
        pairs = F.zip_with(F.slice(ids, 1, n - 1), F.slice(ids, 2, n - 1), lambda a, b: ratios[(a - 1) * len(ALPHABET) + b - 1])
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return let(F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)), of)


def generated(rows: DataFrame) -> DataFrame:
    """Adds ``random``: strings of 16 to 44 characters in each alphabet, from hashes of ``row``."""
    hashed = F.concat(*[F.sha2(F.concat(F.col("row").cast("string"), F.lit(f"-{k}")), 256) for k in range(2)])
    rows = rows.withColumn("hashed", hashed).withColumn("b64", F.regexp_replace(F.base64(F.unhex("hashed")), r"[\r\n]", ""))
    rows = rows.withColumn("letters", F.regexp_replace("b64", "[^A-Za-z]", ""))
    of = [
        F.col("b64"), F.regexp_replace("b64", "[+/=]", ""), F.col("hashed"), F.upper("hashed"), F.upper(F.regexp_replace("b64", "[^A-Za-z2-7]", "")),
        F.col("letters"), F.lower("letters"), F.translate("hashed", "abcdef", "012345"),
    ]
    return rows.withColumn("random", F.array(*[F.substring(v, F.lit(1), F.lit(16) + F.pmod(F.xxhash64("row", F.lit(k)), F.lit(29)).cast("int")) for k, v in enumerate(of)]))


def identifiers(rows: DataFrame) -> DataFrame:
    """Adds ``names``: words of ``words`` joined as programs write them, with numbers."""
    at = lambda k: (F.pmod(F.xxhash64("row", F.lit(k)), F.greatest(F.size("words"), F.lit(1))) + 1).cast("int")
    common = F.array(*map(F.lit, PROGRAM_WORDS))
    usual = lambda k: common[F.pmod(F.xxhash64("row", F.lit(50 + k)), F.lit(len(PROGRAM_WORDS))).cast("int")]
    half = lambda k: F.pmod(F.xxhash64("row", F.lit(70 + k)), F.lit(2)) == 0
    rows = rows.withColumns({n: F.when(half(k), usual(k)).otherwise(F.lower(F.coalesce(F.try_element_at("words", at(k)), usual(k)))) for k, n in enumerate("abcd")})
    a, b, c, d = (F.col(n) for n in "abcd")
    number = lambda k, n: F.pmod(F.xxhash64("row", F.lit(100 + k)), F.lit(n)).cast("string")
    padded = lambda k, n, size: F.lpad(number(k, n), size, "0")
    year, digits = F.concat(F.lit("20"), padded(1, 100, 2)), padded(2, 10_000, 4)
    names = [
        F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), number(3, 20), F.initcap(d)),
        F.concat_ws("_", a, F.concat(F.lit("v"), number(4, 9)), b, year), F.concat_ws("_", a, b, c, number(5, 10_000)), F.concat_ws("_", a, b, F.concat(number(6, 2000), F.lit("x"), number(7, 2000))),
        F.upper(F.concat_ws("_", a, b, c, number(8, 100))), F.concat_ws("/", a, b, year, number(9, 12), c), F.concat_ws("-", year, padded(10, 12, 2), padded(11, 28, 2), digits),
        F.concat_ws("-", digits, padded(12, 10_000, 4), padded(13, 10_000, 4), F.concat(padded(14, 10_000, 4), F.substring(a, 1, 1))),
    ]
    some = lambda k, values: F.array(*map(F.lit, values))[F.pmod(F.xxhash64("row", F.lit(k)), F.lit(len(values))).cast("int")]
    size = F.lit(16) + F.pmod(F.xxhash64("row", F.lit(200)), F.lit(48)).cast("int")
    typed = F.substring(F.repeat(some(201, RUNS), F.lit(8)), F.pmod(F.xxhash64("row", F.lit(202)), F.lit(10)).cast("int") + 1, size)
    alphabets = F.concat(F.lit(RUNS[0]), F.upper(F.lit(RUNS[0])), F.lit(RUNS[3]))
    return rows.withColumn("names", F.array(*names, F.repeat(some(203, RULES), size), typed, F.when(F.pmod(F.xxhash64("row", F.lit(204)), F.lit(4)) == 0, alphabets).otherwise(F.upper(typed))))


def labelled(docs: DataFrame, text: str, sample_rows: int) -> DataFrame:
    """``(random, v)``: random strings (1) and identifiers (0) of the sampled texts, by characters of the alphabet."""
    n = docs.count()
    part = max(1, min(1_000_000, math.ceil(1_000_000 * sample_rows / max(1, n))))
    t = F.coalesce(F.col(text), F.lit(""))
    sample = docs.select(t.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < part)
    words = F.filter(F.array_distinct(F.split("t", SPACE)), lambda w: w.rlike(r"^[A-Za-z_-]{3,}$"))
    sample = sample.select(F.xxhash64("t").alias("row"), words.alias("words"), F.transform(base_spans(F.col("t")), lambda s: s["value"]).alias("found"))
    sample = generated(identifiers(sample)).select(F.concat("found", "random").alias("one"), F.concat("words", "names").alias("none"))
    clean = rf"[^{ALPHABET[:-1]}-]".replace("/", r"\/")
    of = lambda c, which: sample.select(F.lit(which).alias("random"), F.explode(c).alias("v"))
    rows = of("one", 1).union(of("none", 0)).select("random", F.regexp_replace("v", clean, "").alias("v")).where(F.length("v") > 1)
    return written(rows.groupBy("random", "v").agg(F.count(F.lit(1)).alias("n")), "secret-sample")


def folded(token: Column) -> Column:
    """Lower case for tokens without digits."""
    return F.when(token.rlike("[0-9]"), token).otherwise(F.lower(token))


def table_of(ratios: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")


def held(token: Column) -> Column:
    return F.pmod(F.xxhash64(token, F.lit(3)), F.lit(HELD_OUT)) == 0


def histogram(rows: DataFrame, ratios: list[float]) -> list[tuple[int, int, int]]:
    """``(random, bucket of the ratio a character, tokens)`` of the held-out tokens long enough to be scanned."""
    mean = let(table_of(ratios), lambda m: score(folded(F.col("v")), m)) / (F.length("v") - 1)
    rows = rows.where(held(F.col("v")) & (F.length("v") >= MARKOV[3]))
    return [(r.random, r.b, r.n) for r in rows.groupBy("random", F.floor(mean * STEPS).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()]


def threshold(counts: list[tuple[int, int, int]]) -> tuple[float, float, float]:
    """Least ratio a character with the fewest errors, and the share of random tokens and of identifiers that reach it."""
    total = [max(1, sum(n for k, _, n in counts if k == which)) for which in (0, 1)]
    best = None
    for cut in sorted({b for _, b, _ in counts} | {b + 1 for _, b, _ in counts}):
        hit, false = (sum(n for k, b, n in counts if k == which and b >= cut) / total[which] for which in (1, 0))
        cost = 1 - hit + COST * false
        if best is None or cost < best[0]:
            best = cost, cut / STEPS, hit, false
    return best[1:] if best else (0.0, 0.0, 0.0)


def train(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log ratios random : identifier of every pair of characters, less the threshold, from about ``sample_rows`` rows.

    Rows are picked by a hash of the text at a rate that depends on the row count. What comes to
    the driver is two counts for each pair of the alphabet, and a histogram of held-out ratios."""
    rows = labelled(docs, text, sample_rows)
    token = F.when(F.col("random") == 0, folded(F.col("v"))).otherwise(F.col("v"))
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring(F.col("v"), i, F.lit(2)))).alias("p")
    # tokens without digits are scored in lower case, so both classes count that form as well
    known = rows.where(~held(F.col("v"))).select("random", "n", F.explode(F.array_distinct(F.array(token, folded(F.col("v"))))).alias("v"))
    counts = {(r.random, r.p): r.n for r in known.select("random", "n", pairs).groupBy("random", "p").agg(F.sum("n").alias("n")).collect()}
    size = len(ALPHABET)
    if not any(k[0] for k in counts):
        return [-1.0] * size * size

    def logs(which: int, a: str) -> list[float]:
        own = [counts.get((which, a + b), 0) + 0.5 for b in ALPHABET]
        return [math.log(x / sum(own)) for x in own]

    ratios = [r - i for a in ALPHABET for r, i in zip(logs(1, a), logs(0, a), strict=True)]
    least, _, _ = threshold(histogram(rows, ratios))
    return [x - least for x in ratios]


def scan(docs: DataFrame, ratios: list[float], text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, kind, end, value)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def random_ones(tokens: Column) -> Column:
        return let(table_of(ratios), lambda m: F.filter(tokens, lambda s: score(folded(s["value"]), m) >= min_ratio))

    def both(base: Column) -> Column:
        new = F.filter(
            F.col("__markov"),
            lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        return F.sort_array(F.concat(base, new))

    df = docs.withColumns({"base": base_spans(t), "__markov": matches(t, *MARKOV)})
    df = df.withColumn("__markov", F.when(F.size("__markov") > 0, random_ones(F.col("__markov"))).otherwise(F.col("__markov")))
    return df.withColumn("spans", F.when(F.size("__markov") > 0, both(F.col("base"))).otherwise(F.col("base"))).drop("__markov")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced; overlapping spans become one mark."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    end = F.aggregate(spans, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(end)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, train(docs)).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
