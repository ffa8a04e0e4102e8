"""Operators against brute force, and their edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nextbasket.llm import bpe, common, op1_quality, op2_secrets, op3_jaccard, op4_urls, op5_html, op6_substring, op7_bpe, op8_packing, op9_language, op10_embeddings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [None, "", " \t\n", "one", "a b c d", "a b c d", "x " * 3000, "password = Abcdef123 tail", "Ünï wörd é <|endoftext|>", "12 34 !!"]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", None, len(t) if t else None) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Sentences of random words, with copies, near copies and shared passages."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 5)))
    out = [" ".join(word() for _ in range(r.choice([3, 25, 60, 200]))) for _ in range(60)]
    for k in range(30):
        w = out[k % 10 + 20].split()
        w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    passage = " ".join(word() for _ in range(40))
    return out + [f"{out[k]} {passage} {word()}" for k in range(10)] + out[:5] + EDGES


def words(t):
    return (t or "").encode().split()


def test_quality_edges(spark):
    rows = {r.doc_id: r for r in op1_quality.ledger(docs(spark, EDGES).withColumn("n_words", F.lit(1))).collect()}
    assert rows[0].n_words == rows[1].n_words == rows[2].n_words == 0 and rows[6].n_repeat_words == 3000
    assert op1_quality.ledger(docs(spark, [])).count() == 0


def test_secrets(spark):
    key = "AKIA" + "Q" * 16
    texts = [*EDGES, f"x {key} y 0123456789abcdef01234567", 'secret="token":abcdef1', "a zQ8xK2mP9vLr4TnW7yBc b", "thousand_ordinary_words plain-identifier-name"]
    df = docs(spark, texts)
    rows = {r.doc_id: r for r in op2_secrets.scan(df, op2_secrets.train(df)).collect()}
    for k, t in enumerate(texts):
        want = []
        for n, (kind, rx, g, least) in enumerate([("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
            want += [(m.start(), n, kind, m.end()) for m in re.finditer(rx, t or "", re.I | re.A if n == 0 else 0) if len(m[g]) >= least]
        assert [(s.start, s.kind, s.end) for s in rows[k].base] == [(a, c, d) for a, _, c, d in sorted(want)]
    flat = [1.0 if (a.isdigit() != b.isdigit()) else -0.2 for a in op2_secrets.ALPHABET for b in op2_secrets.ALPHABET]
    got = {r.doc_id: [s.kind for s in r.spans] for r in op2_secrets.scan(df, flat, min_ratio=2.0).collect()}
    assert "markov" in got[len(EDGES) + 2] and got[len(EDGES) + 3] == []
    out = op2_secrets.scan(df, flat, min_ratio=2.0).select("doc_id", op2_secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert key not in {r.doc_id: r.t for r in out}[len(EDGES)]


def test_secrets_of_one_class(spark):
    r = random.Random(9)
    of = lambda chars, n=24: "".join(r.choice(chars) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    every = lower + lower.upper() + "0123456789"
    prose = "some ordinary words of the language that make up the thousand names and phrases in a normal text with further information"
    seen = [f"{prose} {' '.join(r.choice(prose.split()) for _ in range(20))} password={of(every)} {of('0123456789abcdef', 32)}" for _ in range(300)]
    found = [of(lower), of(lower.upper()), of(lower + lower.upper()), of("0123456789")]
    kept = ["informationlanguage", "INFORMATIONLANGUAGE", "thousand_ordinary_names", "ThousandOrdinaryNames"]
    df = docs(spark, [f"a {x} b" for x in found + kept])
    rows = {x.doc_id: [s.value for s in x.spans] for x in op2_secrets.scan(df, op2_secrets.train(docs(spark, seen))).collect()}
    assert [rows[k] for k in range(len(found + kept))] == [[x] for x in found] + [[]] * len(kept)


def test_jaccard(spark, corpus):
    got = {r.doc_id: r for r in op3_jaccard.components(docs(spark, corpus), wide=4, block=4).collect()}
    sets = []
    for t in corpus:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(sets))] == [(len(s), root(k)) for k, s in enumerate(sets)]
    assert op3_jaccard.components(docs(spark, [])).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.example.COM/en/x", "http://www.example.com/en/1", "https://x.net/es/?q", "http://net/fr/", "http://b.org/z"]
    rows = op4_urls.ruled(op4_urls.parsed(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == [("", "", None)] * 3 + [("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("x.net", "/es/", "net/es/"), ("net", "/fr/", "net/fr/"), ("b.org", "/z", None)]
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{'9' * (k % 2 * 9)}x") for k in range(60)], "page_id long, url string")
    labelled = pages.selectExpr("url", "if(url like '%999%', 1, 0) as label")
    bad = {r.page_id: r.verdict for r in op4_urls.judged(pages, labelled=labelled).collect()}
    assert all((bad[k] == "block") == (k % 2 == 1) for k in range(60))


def test_html(spark):
    page = lambda body: f"<html><body><header>Site</header><div>Hello reader</div><div>{body}</div><footer>f</footer></body></html>"
    rows = [(k, "http://h.org/x", page(f"Text number {k} &amp; more<script>no()</script>")) for k in range(8)] + [(8, None, None), (9, "http://h.org/a", "<article><h1>T</h1><p>a<b>b</b><p>c</article><aside>z</aside>")]
    got = {r.page_id: r.text for r in op5_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3 & more" and got[8] == "" and got[9] == "T ab c"


def test_html_constants_inside_an_article(spark):
    page = lambda k, body: f"<body><p>n{k}</p><article><h1>T{k}</h1><div class='box'>Join <b>our</b> club today</div><p>{body}</p></article></body>"
    long = "A story that several hosts copy word for word. " * 3
    rows = [(k, "http://h.org/x", page(k, f"Story {k} of many, with <b>club</b> words.")) for k in range(8)]
    rows += [(20 + k, "http://copies.org/x", f"<body><p>n{k}</p><article><p>Head</p><p>{long}</p></article></body>") for k in range(5)]
    other = lambda k: f"<body><main><section class='s'>Buy now</section><p>Other layout {k}</p></main></body>"
    rows += [(40 + k, "http://h.org/y", other(k)) for k in range(3)]
    got = {r.page_id: r.text for r in op5_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"T{k} Story {k} of many, with club words." for k in range(8))
    assert all(got[20 + k] == f"Head {long.strip()}" for k in range(5))
    assert all(got[40 + k] == f"Other layout {k}" for k in range(3))


def test_substrings(spark, corpus):
    got = {r.doc_id: r for r in op6_substring.removed(docs(spark, corpus), op6_substring.repeats(docs(spark, corpus), hot=3, shard_words=500)).collect()}
    seen, texts = set(), [words(t) for t in corpus]
    for k, w in enumerate(texts):
        gone = set()
        for i in range(len(w) - 19):
            win = tuple(w[i : i + 20])
            if win in seen:
                gone |= set(range(i, i + 20))
            seen.add(win)
        assert got[k].n_removed == len(gone), k
        assert got[k].kept.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_hot_windows_do_not_meet_in_a_shard(spark, monkeypatch):
    r = random.Random(6)
    of = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = of(60)
    df = docs(spark, [f"{of(15)} {passage} {of(15)}" for _ in range(60)])
    dealt, searched = [], op6_substring.searched

    def spy(rows, *args):
        dealt.append(rows.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0)
        return searched(rows, *args)

    monkeypatch.setattr(op6_substring, "searched", spy)
    got = {x.doc_id: x.n_removed for x in op6_substring.removed(df, op6_substring.repeats(df, hot=10)).collect()}
    assert got == {k: 60 if k else 0 for k in range(60)} and dealt[0] <= 10


def test_bpe_and_packing(spark, corpus):
    tok = bpe.load(bpe.source())
    ids = [tok.encode(t or "", add_special_tokens=False).ids for t in corpus]
    got = {r.doc_id: r for r in op7_bpe.encode(docs(spark, corpus)).collect()}
    for k, own in enumerate(ids):
        assert list(got[k].ids) == own and got[k].decoded == tok.decode(own, skip_special_tokens=False)
    odd = ["don't", "A" * 60, "É,", "a\xa0b", "'s", "--a", "你好", "A×B", "hello,,"]
    for at, flat, offs in bpe.Encoder(bpe.source()).encode(pa.array(odd)):
        assert [flat[s:e].tolist() for s, e in zip(offs[:-1], offs[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in odd]
    rows = op8_packing.pack(docs(spark, corpus), group_docs=20).collect()
    seqs: dict = {}
    for r in rows:
        part = ([*ids[r.doc_id], 1])[r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids)) + len(ids)
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048


def test_language(spark):
    r = random.Random(1)
    en, de = "the of and then hand other with from".split(), "der und schön über nicht eine auch für".split()
    rows = [(k, " ".join(r.choice(de if k % 2 else en) for _ in range(30)), "de" if k % 2 else "en", None, 0) for k in range(80)]
    model = op9_language.fit(spark.createDataFrame(rows, SCHEMA))
    got = {x.doc_id: x for x in op9_language.identify(spark.createDataFrame(rows + [(100 + k, t, None, None, 0) for k, t in enumerate(EDGES)], SCHEMA), model).collect()}
    assert all(got[k].lang_pred == ("de" if k % 2 else "en") for k in range(80))
    assert [got[100 + k].lang_pred for k in (0, 1, 2, 9)] == ["und"] * 4 and got[100].score == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "▁"]
    lat = op9_language.Lattice(pieces, np.array([[0.4], [0.3], [0.2], [0.1]]))
    assert abs(np.exp(lat.scores(["▁ab"])[0, 0]) - 0.1 * (0.3 + 0.4 * 0.2)) < 1e-12


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((20, 16))
    rows = [(k, [float(x) for x in base[k % 20] + 0.02 * r.standard_normal(16)], int(k % 20) % 3) for k in range(80)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, rows[0][1], None), (104, rows[0][1], rows[0][2]), (105, [1.0, 2.0], 1)]
    got = {x.vec_id: x for x in op10_embeddings.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(np.array(v, np.float32), float), lab) for i, v, lab in rows if i < 100 or i == 104]
    links = {i: sum(j != i and lab == m and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98 for j, w, m in ok) for i, v, lab in ok}
    assert sum(got[i].n_links for i in links) >= 0.9 * sum(links.values())
    assert all(got[i].n_links <= n for i, n in links.items())
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (100, 101, 102, 103, 105))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.connected(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)}


def test_jaccard_of_many_near_copies_is_linear(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(2000):
        w = list(base)
        w[r.randrange(120)] = f"x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{k}-{j}" for j in range(30)) for k in range(40)]
    sent, passing, verified = [], op3_jaccard.passing, op3_jaccard.verified

    def counted(compare):
        def f(members, percent):
            out = common.written(compare(members, percent), "counted")
            sent.append(out.count())
            return out

        return f

    monkeypatch.setattr(op3_jaccard, "passing", counted(passing))
    monkeypatch.setattr(op3_jaccard, "verified", counted(verified))
    got = {x.doc_id: x.component_id for x in op3_jaccard.components(docs(spark, texts), wide=32, block=32).collect()}
    assert all(got[k] == (0 if k < 2000 else k) for k in got) and len(got) == len(texts)
    assert sum(sent) < 2 * len(texts), sent


def test_jaccard_of_copies_in_a_chain(spark):
    """Neighbours link, sets further apart do not: what a pivot does not join is joined across blocks."""
    w = [f"w{k}" for k in range(400)]
    texts = [" ".join(w[k : k + 100]) for k in range(0, 300, 4)]
    got = {x.doc_id: x.component_id for x in op3_jaccard.components(docs(spark, texts), wide=4, block=4).collect()}
    assert set(got.values()) == {0}


def test_jaccard_sends_long_runs_in_parts(spark, corpus, monkeypatch):
    want = sorted(op3_jaccard.components(docs(spark, corpus)).collect())
    monkeypatch.setattr(op3_jaccard, "RUN_SETS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(op3_jaccard.components(docs(spark, corpus), wide=2, block=2).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_html_of_odd_shapes():
    import time

    start = time.time()
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    wide = "".join(f"<p>n{k}</p>" for k in range(20_000))
    bold = "<article>" + "<b>" * 5000 + "x"
    assert op5_html.main_text(deep, None) == "core" and op5_html.main_text(bold, None) == "x"
    assert op5_html.main_text(f"<main>{wide}</main>", None) == " ".join(f"n{k}" for k in range(20_000))
    assert op5_html.main_text('text <a "' * 30_000, None).startswith("text")
    assert op5_html.main_text("a < b <3 <i>c</i>", None) == "a < b <3 c"
    rows = op5_html.wrapper([f"<body><div>Same</div>{deep}<p>a{k}</p>{''.join(f'<p>{k}-{j}</p>' for j in range(2000 + 500 * k))}</body>" for k in range(3)])
    wrap = op5_html.unflat(rows)
    assert op5_html.flat(wrap) == rows and "Same" not in op5_html.main_text("<body><div>Same</div><p>z</p></body>", wrap)
    assert time.time() - start < 60


def test_html_alignment_equals_brute_force():
    r = random.Random(3)

    def make(depth):
        return (r.choice("ab"), [make(depth - 1) for _ in range(r.randint(0, 3))] if depth else [])

    def node(t):
        n = op5_html.Node(t[0])
        n.kids = [node(k) for k in t[1]]
        return n

    def most(x, y):
        """Pairs in the largest match."""
        if x[0] != y[0]:
            return 0
        table = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, p in enumerate(x[1]):
            for j, q in enumerate(y[1]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + most(p, q))
        return table[-1][-1] + 1

    for _ in range(300):
        a, b = make(3), make(3)
        pairs = op5_html.align(op5_html.shaped(node(a)), op5_html.shaped(node(b)))
        assert len(pairs) == most(a, b) and len({id(x) for x, _ in pairs}) == len(pairs)


def test_html_class_words_of_many_meanings(spark):
    page = lambda k, body: f"<body><article><h1>T{k}</h1>{body}<p>end {k}</p></article></body>"
    rows = [(k, "http://h.org/x", page(k, f'<div class="social-share">Pass it on {k * 7919}</div>')) for k in range(4)]
    rows += [(9, "http://h.org/y", page(9, '<section class="ad-hoc analysis">An ad-hoc look</section><p class="share of market">A third</p>'))]
    rows += [(20 + k, f"http://one{k}.org/", page(k, '<div class="ad">Buy</div>')) for k in range(2)]
    got = {r.page_id: r.text for r in op5_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"T{k} end {k}" for k in range(4))
    assert got[9] == "T9 An ad-hoc look A third end 9" and got[20] == "T0 end 0" and got[21] == "T1 end 1"


def test_html_wrapper_decides_inside_an_article(spark):
    """Two distinct pages are enough for the wrapper, which all-page constants leave alone."""
    page = lambda k: f"<body><article><div>Read our terms</div><p>Story {k} has words of its own, more than the terms</p></article></body>"
    rows = [(k, "http://h.org/x", page(k)) for k in range(2)]
    got = {r.page_id: r.text for r in op5_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} has words of its own, more than the terms" for k in range(2)}


def test_trained_secrets_tell_random_strings_from_names(spark):
    r = random.Random(12)
    prose = "some ordinary words of the language that make up the thousand names and phrases in a normal text with further information".split()
    model = op2_secrets.train(docs(spark, [" ".join(r.choice(prose) for _ in range(25)) + f" {k}" for k in range(400)]))
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    found = [of(base62, 20) for _ in range(40)] + [of("0123456789ABCDEF", 16) for _ in range(40)]
    kept = ["application_v2_config_2024", "https_proxy_port_8080", "getUserById2HandlerFactory", "user_profile_image_1024x768", "1234-5678-9012-3456a"]
    df = docs(spark, [f"a {x} b" for x in found + kept])
    hit = {x.doc_id: any(s.kind == "markov" for s in x.spans) for x in op2_secrets.scan(df, model).collect()}
    assert sum(hit[k] for k in range(40)) >= 38 and sum(hit[k] for k in range(40, 80)) >= 36
    assert not any(hit[80 + k] for k in range(len(kept)))
    assert op2_secrets.threshold([(1, 5, 90), (1, 1, 10), (0, 0, 100)]) == (1 / op2_secrets.STEPS, 1.0, 0.0)


def test_url_trees_equal_plain_boosting(spark):
    """Splits and leaves of one tree against a plain search over all cuts, then the figures of held-out rows."""
    r = random.Random(2)
    urls = [f"http://h{r.randrange(4)}.{r.choice(['org', 'biz'])}/{'-'.join('w' * r.randint(1, 6) for _ in range(r.randint(1, 4)))}{r.choice(['', '?a=1&b=2'])}" for _ in range(200)]
    label = [int(("biz" in u) != (r.random() < 0.1)) for u in urls]
    base = op4_urls.ruled(op4_urls.parsed(spark.createDataFrame(list(zip(urls, label, strict=True)), "url string, label int")))
    known = op4_urls.features(base, op4_urls.suffixes(base)).cache()
    margin = op4_urls.fit(known, trees=1, depth=1)
    rows = known.withColumn("m", F.expr(margin)).collect()
    x = {f: [row[f] for row in rows] for f in op4_urls.FEATURES}
    y = [row.label for row in rows]
    p = sum(y)
    start = math.log((p + 0.5) / (len(y) - p + 0.5))
    prob = 1 / (1 + math.exp(-start))
    g, h = [v - prob for v in y], prob * (1 - prob)
    worth = lambda own: sum(g[i] for i in own) ** 2 / (h * len(own) + op4_urls.PENALTY)
    edges = op4_urls.edges_of(known)
    best = max(((worth(low) + worth(high), f, c) for f in op4_urls.FEATURES for c in edges[f] if (low := [i for i in range(200) if x[f][i] < c]) is not None and (high := [i for i in range(200) if x[f][i] >= c]) is not None), key=lambda t: t[0])
    for side in (0, 1):
        own = [i for i in range(200) if (x[best[1]][i] < best[2]) == (side == 0)]
        leaf = start + op4_urls.STEP * sum(g[i] for i in own) / (h * len(own) + op4_urls.PENALTY)
        assert all(abs(rows[i].m - leaf) < 1e-9 for i in own)
    scores = [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0), (0.1, 0)]
    found = op4_urls.roc([(int(s * 1000), int(not b), b) for s, b in scores])
    assert abs(found["auc"] - 5 / 6) < 1e-9 and found["cut"] == 0.7


def test_url_features(spark):
    urls = ["http://a.b.org/x-1/y?p=1&q=2", None]
    base = op4_urls.ruled(op4_urls.parsed(spark.createDataFrame(list(enumerate(urls)), "k int, url string")))
    rows = op4_urls.features(base, op4_urls.suffixes(base)).orderBy("k").collect()
    u = urls[0]
    counts = [u.count(c) / len(u) for c in set(u)]
    want = {"length": len(u), "depth": 2, "digit_ratio": 3 / len(u), "entropy": -sum(c * math.log2(c) for c in counts), "params": 2, "host_parts": 3, "hyphens": 1, "suffix_share": 0.5}
    assert all(abs(rows[0][k] - v) < 1e-6 for k, v in want.items()) and rows[1]["length"] == rows[1]["entropy"] == 0


def test_urls_without_a_signal_block_nothing(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}") for k in range(400)], "page_id long, url string")
    labelled = pages.selectExpr("url", "cast(crc32(concat('x', url)) % 2 as int) as label")
    assert {r.verdict for r in op4_urls.judged(pages, labelled=labelled).collect()} == {"allow"}
    assert op4_urls.judged(pages.limit(0), labelled=labelled.limit(0)).count() == 0


def test_long_words_are_scored_whole():
    """Against a plain forward pass in logarithms, over words that underflow and pieces of any length."""
    r = random.Random(7)
    pieces = ["a", "b", "ab", "abba" * 4, "\u2581", "ba", "aaaaaaaaaaaa"]
    probs = np.array([[r.random(), r.random()] for _ in pieces])
    lat = op9_language.Lattice(pieces, probs / probs.sum(0))
    words = ["\u2581" + "".join(r.choice("abz") for _ in range(n)) for n in (1, 3, 40, 700)] + ["\u2581" + "abba" * 200]
    got = lat.scores(words)
    for w, row in zip(words, got, strict=True):
        for lang in range(2):
            p = dict(zip(pieces, lat.probs[2:, lang], strict=True))
            f = [0.0] + [-math.inf] * len(w)
            for e in range(1, len(w) + 1):
                arcs = [f[e - n] + math.log(p.get(w[e - n : e], op9_language.UNKNOWN if n == 1 else 0) or 1e-320) for n in range(1, min(16, e) + 1) if w[e - n : e] in p or n == 1]
                top = max(arcs)
                f[e] = top + math.log(sum(math.exp(x - top) for x in arcs))
            assert abs(row[lang] - f[-1]) < 1e-6 * max(1, abs(f[-1]))


def test_width_of_ids():
    small, large = ('{"model": {"vocab": {"a": 0, "b": %d}}}' % n for n in (65535, 65536))
    assert op8_packing.width(small) == "<u2" and op8_packing.width(large) == "<u4"


def test_substrings_of_rows_that_share_an_id(spark):
    r = random.Random(8)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    first, own, passage = make(60), make(50), make(30)
    rows = [(1, first), (5, f"{make(10)} {first}"), (5, own), (5, own), (6, f"{make(3)} {passage}"), (6, f"{passage} {make(40)}"), (None, first)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.text, x.n_removed) for x in op6_substring.deduplicated(df.withColumn("n_removed", F.lit("old")).withColumn("spans", F.lit(1))).collect()]
    assert (5, own, 0) in got and got.count((5, own, 0)) == 2 and (1, first, 0) in got and (None, first, 0) in got
    assert [x[2] for x in got if x[0] == 5 and x[1] != own] == [60]
    assert sorted(x[2] for x in got if x[0] == 6) == [0, 30]  # one of the two keeps the passage


def test_expected_counts_equal_all_segmentations(monkeypatch):
    """EM's counts against a list of all ways to cut, for words of plain and of rescaled sums; very long words keep all their letters."""
    monkeypatch.setattr(op9_language, "LONGEST", 5)
    pieces = ["▁", "a", "ab", "abc", "b", "▁a", "bb"]
    probs = np.random.default_rng(2).random((len(pieces), 2)) / 9
    lattice = op9_language.Lattice(pieces, probs)
    words, counts = ["▁ab", "▁abcab", "▁xab", "▁aabbcabbab"], np.array([[2.0, 1.0], [1.0, 3.0], [0.5, 0.0], [4.0, 1.0]])
    want = np.zeros_like(probs)

    def cuts(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in pieces or n == 1:
                yield from ([w[:n], *rest] for rest in cuts(w[n:]))

    value = lambda p: probs[pieces.index(p)] if p in pieces else np.full(2, op9_language.UNKNOWN)
    for w, c in zip(words, counts, strict=True):
        ways = [(way, np.prod([value(p) for p in way], axis=0)) for way in cuts(w)]
        z = sum(x for _, x in ways)
        for way, x in ways:
            for p in way:
                if p in pieces:
                    want[pieces.index(p)] += c * x / z
    assert np.allclose(lattice.expected(words, counts), want)
    long = lattice.expected(["▁" + "ab" * 3000], np.ones((1, 2)))
    letters = np.array([len(p.strip("▁")) for p in pieces])
    assert np.allclose(letters @ long, 6000)


def test_harmless_runs_are_no_secrets(spark):
    r = random.Random(10)
    prose = "some ordinary words of the language that make up the thousand names and phrases in a normal text with further information"
    seen = [f"{prose} {' '.join(r.choice(prose.split()) for _ in range(20))} password={r.getrandbits(100):x} ok" for _ in range(300)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    kept = ["-" * 16, "_" * 20, "=" * 40, "/" * 60, letters, letters.upper(), letters + letters.upper(), "qwertyuiopasdfghjkl", "12345678901234567890", "0" * 32]
    every = letters + letters.upper() + "0123456789"
    found = ["".join(r.choice(every) for _ in range(32)) for _ in range(20)]
    df = docs(spark, [f"a {x} b" for x in kept + found])
    rows = {x.doc_id: [s.value for s in x.spans if s.kind == "markov"] for x in op2_secrets.scan(df, op2_secrets.train(docs(spark, seen))).collect()}
    assert [rows[k] for k in range(len(kept))] == [[]] * len(kept)
    assert sum(rows[len(kept) + k] == [x] for k, x in enumerate(found)) >= 18


def test_html_main_beside_a_card():
    story = "The story goes on for a while and ends well. " * 5
    text = op5_html.main_text(f"<main><h1>Title</h1><p>{story}</p><article><h2>Card</h2><p>Read this next</p></article></main>", None)
    assert text == f"Title {story}".strip()
    text = op5_html.main_text(f"<main><p>Lead</p><article><h1>Title</h1><p>{story}</p></article></main>", None)
    assert text == f"Title {story}".strip()
