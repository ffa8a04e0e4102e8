"""Queries of this subpackage, with SQL where it can express them."""

from importlib import import_module

MODULES = ["op1_quality", "op2_secrets", "op3_jaccard", "op4_urls", "op5_html", "op6_substring", "op7_bpe", "op8_packing", "op9_language", "op10_embeddings", "op11_phrases", "op12_spelling", "op13_sharding"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").ORACLES
    return out
