"""Column expressions: all JVM-side, no UDF."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel names, price bands (upper end, label) and title keywords (name, pattern).
SOURCES = {"pos": "pos", "web": "web", "shopify_draft_order": "draft"}
BANDS = [(0, None), (10, "<10"), (15, "10-15"), (25, "15-25"), (50, "25-50"), (100, "50-100")]
KEYWORDS = [
    ("exclusive", "exclusive"), ("chase", r"\bchase\b"), ("vault", "vault"), ("glow", "glow"), ("flocked", "flocked"),
    ("metallic", "metallic"), ("diamond", "diamond"), ("limited", "limited"), ("convention", r"\b(sdcc|nycc|eccc|comic[- ]?con)\b"),
]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_money(amount: Column) -> Column:
    return amount.try_cast("double")


def hash_customer(customer: Column, salt: bytes) -> Column:
    """First 16 hex digits of HMAC-SHA256; null and empty give null."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(customer, "UTF-8")), 256)
    full = F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)
    return F.when(F.nullif(customer, F.lit("")).isNotNull(), F.substring(full, 1, 16))


def gid_number(gid: Column) -> Column:
    return F.substring_index(F.nullif(gid, F.lit("")), "/", -1).cast("bigint")


def coarse_source(name: Column) -> Column:
    name = strip(F.coalesce(name, F.lit("")))
    out = F.when(name.rlike("^[0-9]+$"), "app").otherwise("other")
    for k, v in SOURCES.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def order_day(created: Column) -> Column:
    return F.to_date(F.substring(created, 1, 10))


def price_band(price: Column) -> Column:
    """Half-open bands; null counts as 0, a negative price as the top band."""
    p, out = F.coalesce(price, F.lit(0.0)), F.lit("100+")
    for (low, _), (high, label) in reversed(list(zip(BANDS, BANDS[1:], strict=False))):
        out = F.when((p >= low) & (p < high), label).otherwise(out)
    return out


def title_keywords(title: Column) -> Column:
    flags = [F.when(title.rlike(f"(?iu){p}"), F.lit(n)) for n, p in KEYWORDS]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def item_tokens(title: Column, tags: Column, price: Column) -> Column:
    named = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: strip(t) != "")
    tag = F.transform(named, lambda t: F.concat(F.lit("tag:"), F.lower(strip(t))))
    kw = F.transform(title_keywords(F.coalesce(title, F.lit(""))), lambda k: F.concat(F.lit("kw:"), k))
    return F.array_sort(F.array_distinct(F.concat(tag, kw, F.array(F.concat(F.lit("price:"), price_band(price))))))


def catalog_number(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"#\s?(\d{1,5})", 1), F.lit(""))


def quantized(score: Column) -> Column:
    """An integer key on which ranks don't depend on the order of a sum."""
    return F.floor(score * 1e12 + 0.5).cast("bigint")
