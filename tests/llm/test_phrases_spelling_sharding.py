"""Phrases, spelling variants and shards against plain Python, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nextbasket.llm import op11_phrases, op12_spelling, op13_sharding

SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "n", "rank", "phrase", "size", "shard", "slot", "f", "a", "key", "part")})


# ---- phrases -----------------------------------------------------------------------------------


def phrases_of(rows, least, longest, top):
    f, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for n in range(1, longest + 1):
                for i in range(len(ws) - n + 1):
                    f[lang, tuple(ws[i : i + n])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, p), a in cand.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i : i + n]] = max(longer[lang, p[i : i + n]], a)
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * longer[lang, p] < 50 * a:
            score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k, -s, -a, p.decode(), l, r, total[lang]) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


@pytest.fixture(scope="module")
def prose():
    r = random.Random(4)
    words = ["a", "b", "Ab", "été", "É", "don't", "x" * 300, "new", "york", "city", "-", " ", "z y"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", "\x0b", ";"]) for _ in range(n))
    rows = [(k, text(r.choice([1, 20, 200])), r.choice(["en", "de", None]), "s") for k in range(60)]
    rows += [(None, None, "en", None), (3, "", None, None), (5, "New York City " * 400, "en", None), (5, "New York City " * 400, "en", None), (7, " ,. \t\n", "fr", None)]
    return rows


@pytest.mark.parametrize(("longest", "top", "head", "dense"), [(3, 40, 1 << 16, 1 << 14), (3, None, 5, 1), (4, 1000, 3, 4)])
def test_phrases(spark, prose, monkeypatch, longest, top, head, dense):
    """All words ranked; few ranked, so that most pairs are hashed ones; dense tiles, and phrases of four words."""
    monkeypatch.setattr(op11_phrases, "DENSE", dense)
    monkeypatch.setattr(op11_phrases, "BATCH", 500)
    monkeypatch.setattr(op11_phrases, "HELD", 30)
    got = op11_phrases.phrases(table(spark, prose), least=4, longest=longest, top=top, head=head).collect()
    assert {(r.lang, r["rank"], r.score, r.a, r.phrase, r.l, r.r, r.n) for r in got} == phrases_of(prose, 4, longest, top)


def test_phrases_of_no_rows(spark):
    assert op11_phrases.phrases(table(spark, [])).count() == 0
    assert op11_phrases.phrases(table(spark, [(1, None, None, None), (2, "one two", "en", None)])).count() == 0


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    rows = spark.createDataFrame([(0, 0, 0)], "w0 long, w1 long, a long")
    big = 10**14 + 7
    one = spark.createDataFrame([(0, big, "en", "p")], "w0 long, a long, lang string, phrase string")
    two = rows.select("w0", "w1", F.lit(big - 3).alias("a"), F.lit("en").alias("lang"), F.lit("p p").alias("phrase"))
    got = op11_phrases.scored([one, two], 2).first()
    assert got.score == 1000000 * (big - 3) ** 2 // (big * big)


# ---- spelling ----------------------------------------------------------------------------------


def words_of(rows, shortest=7, least=2, damaged=31):
    n = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % damaged == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= shortest
    return {w: c for w, c in n.items() if c >= least}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows, ratio=10, **kw):
    n = words_of(rows, **kw)
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {w: min(own, key=lambda v: (-n[v], v)) for w, own in near.items() if own}
    form = {w: v for w, v in form.items() if n[v] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


@pytest.fixture(scope="module")
def letters():
    """Words of few letters, so that near ones abound; repeated letters; very long words, nulls and repeated rows."""
    r = random.Random(6)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 10))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "Ünïçødes", "q" * 90 + "r" * 90]

    def changed(w):
        k, c = r.randrange(len(w)), r.choice("abcéÀ")
        return r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w, w.upper() if w.isascii() else w])

    rows = [(k, " ".join(changed(r.choice(base)) + r.choice(["", ",", "1", "Ā", "×"]) for _ in range(120)), "en", "s") for k in range(40)]
    rows += [(k, " ".join(base[:5]) * 40, "en", "s") for k in range(3)]
    return [*rows, (None, rows[0][1], None, None), (4, None, None, None), (5, "", None, None), rows[1], (9, "é" * 500 + " " + "é" * 499, None, None), (10, "é" * 500 + " " + "é" * 499, None, None)]


@pytest.mark.parametrize("cap", [2000, 3])
def test_spelling(spark, letters, monkeypatch, cap):
    """``cap`` 3 cuts the lists of pivots."""
    monkeypatch.setattr(op12_spelling, "CAP", cap)
    monkeypatch.setattr(op12_spelling, "PAIRS", 700)
    monkeypatch.setattr(op12_spelling, "HELD", 50)
    got = op12_spelling.variants(table(spark, letters), ratio=3).collect()
    want = variants_of(letters, 3)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(w[4] for w in want) > 500 and any(w[1] and w[2] != w[1] for w in want)


def test_spelling_of_no_rows(spark):
    assert op12_spelling.variants(table(spark, [])).count() == 0
    assert op12_spelling.variants(table(spark, [(1, None, None, None), (2, "lonesome words", "en", None)])).count() == 0


def test_crc_of_ranges():
    r = random.Random(1)
    data = np.frombuffer(bytes(r.randrange(256) for _ in range(500)), np.uint8)
    first = np.array([0, 3, 100, 100, 490])
    last = np.array([0, 4, 141, 240, 500])
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(5)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(first, last, before, strict=True)]
    assert op12_spelling.crc_of(data, first, last, before).tolist() == want


# ---- shards ------------------------------------------------------------------------------------


def checked(spark, rows, **kw):
    got = op13_sharding.shard(table(spark, rows), **kw).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len(raw(t)) + 1, zlib.crc32(raw(t))) for k, t, *_ in rows)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    slots, loads = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, loads


def test_shards(spark):
    r = random.Random(3)
    rows = [(k, "w" * r.choice([0, 5, 50, 300]) + str(r.randrange(200)), r.choice(["en", "de", None]), f"s{r.randrange(4)}") for k in range(3000)]
    rows += [(None, "same text", "en", "s"), (3001, None, None, None), (3001, None, None, None), (3002, "", "en", None), (3009, "L" * 20_000, "de", "big")]
    got, loads = checked(spark, rows)
    total = sum(loads.values())
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= max(20_001, 0.02 * total / 8) and sorted(loads.values())[-1] <= total / 8 * 1.05
    text = {k: t for k, t, *_ in rows}
    where = defaultdict(set)
    for x in got:
        if x.doc_id is not None:
            where[text[x.doc_id] or ""].add(x.shard)
    assert all(len(s) == 1 for s in where.values())
    again = {(x.doc_id, x.shard) for x in op13_sharding.shard(table(spark, rows).repartition(7)).collect()}
    assert again == {(x.doc_id, x.shard) for x in got}


def test_shards_of_a_text_that_fills_several(spark):
    rows = [(k, "copy" * 10, "en", "s") for k in range(2000)] + [(5000 + k, f"own text {k}" * 3, "de", "t") for k in range(2000)]
    _, loads = checked(spark, rows)
    assert set(loads) == set(range(8)) and max(loads.values()) < 1.02 * min(loads.values())


def test_shards_of_equal_metadata_and_few_rows(spark):
    _, loads = checked(spark, [(k, f"{k:05d}", "en", "s") for k in range(4000)], fine=4)
    assert max(loads.values()) < 1.01 * min(loads.values())
    _, loads = checked(spark, [(k, f"{k}", "en", "s") for k in range(3)])
    assert sum(loads.values()) == 6
    assert op13_sharding.shard(table(spark, [])).count() == 0
    got, loads = checked(spark, [(k, f"{k:06d}", "en", "s") for k in range(500)], shards=None, target_bytes=700)
    assert set(loads) == set(range(5)) and max(loads.values()) <= 735


def test_near_words_of_no_pairs_and_of_long_ones_only():
    flat = np.frombuffer(b"a" * 50 + b"a" * 49 + b"b" * 50, np.uint8)
    offs = np.array([0, 50, 99, 149])
    none = np.zeros(0, np.int64)
    assert op12_spelling.near(flat, offs, none, none).tolist() == []
    assert op12_spelling.near(flat, offs, np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]
