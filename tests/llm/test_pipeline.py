"""The pipeline on a small table, against plain Python."""

import random
import zlib

import numpy as np

import corpus_pipeline
from nextbasket.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
EN, DE = "the of and then hand other with from over under more".split(), "der und schön über nicht eine auch für wenn aber noch".split()


def removed(texts):
    """Words that no earlier window of 20 covers."""
    seen, out = set(), {}
    for k in sorted(texts):
        w, gone = texts[k].split(), set()
        for i in range(len(w) - 19):
            win = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if win in seen else set()
            seen.add(win)
        out[k] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[k]
    return out


def test_small_run(spark, tmp_path):
    r = random.Random(3)
    make = lambda words, n: " ".join(r.choice(words) + str(r.randrange(9) if r.random() < 0.1 else "") for _ in range(n))
    rows = {k: (make(DE if k % 2 else EN, 80), "de" if k % 2 else "en") for k in range(60)}
    rows[60] = (rows[3][0], "de")
    rows[61] = (rows[4][0] + " tail", "en")
    passage = make(EN, 30)
    rows |= {62 + k: (f"{make(EN, 40)} {passage} {make(EN, 20)}", "en") for k in range(2)}
    rows[64] = (make(EN, 60) + " password=Abcdef123456", "en")
    rows[65], rows[66] = (None, "en"), ("12 34 !!", "en")
    data = [(k, t, lang, "s", len(t) if t else None, 1) for k, (t, lang) in rows.items()] + [(64, rows[64][0], "en", "s", 1, 1), (None, make(EN, 50), "en", "s", 1, 1)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        after[name] = docs.collect()
    ids = lambda name: sorted(x.doc_id for x in after[name] if x.doc_id is not None)
    assert ids("language") == sorted([*range(65), 64])
    assert ids("near_duplicates") == [k for k in range(65) if k not in (60, 61)] and sum(x.doc_id is None for x in after["near_duplicates"]) == 1
    want = removed({x.doc_id: x.text for x in after["near_duplicates"] if x.doc_id is not None})
    assert {x.doc_id: x.text for x in after["substrings"] if x.doc_id is not None} == want
    last = {x.doc_id: x.text for x in after["secrets"]}
    assert "Abcdef123456" not in last[64] and "[secret]" in last[64]
    tok = bpe.load(bpe.source())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {k: [*tok.encode(t, add_special_tokens=False).ids, 1] for k, t in last.items()}
    assert sum(x.length for x in packed) == sum(map(len, tokens.values()))
    for x in packed:
        assert zlib.crc32(np.array(tokens[x.doc_id][x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
