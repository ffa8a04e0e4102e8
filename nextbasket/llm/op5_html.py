"""Main text of web pages by wrapper induction.

For each host a few different pages, picked by hash, are aligned by simple tree matching: text of
the best matching one that half of the others share is template, the other text nodes are slots.
The wrapper is a small tree (tags, and hashes of constant text). Every page is aligned with its
host's wrapper: runs of text that are constant are dropped anywhere, slots are content unless markup says
that they are a menu, header, footer, sidebar, notice, advert, form, script, style or reader
comment. If a page has an ``article``, its slots are looked for there; or in its ``main``, if it has no article
or the articles hold less than half of the text there. Class words
of many meanings (``WEAK``) count only for a block that the host repeats: one whose path lies on
two pages of it at least, or whose host has one page only. Runs of text that at least
``LEAST_PAGES`` distinct pages of a host, and half of those with anything at that path, share
are template as well, counted over all its pages. Copies of a page count once (they share their
longest run that is not frequent, or most of their text), so they don't lose theirs. A path holds
tags and classes, so each layout has its own counts.

Children are matched from both ends while their shapes are equal; what is left between is matched
in full, whatever its length. Trees of any depth are walked without recursion.

Null html counts as empty: empty text. Null urls and those without ``://`` share one host.
White space is collapsed, blocks are joined by one space. Other columns are ignored, repeated
rows each get their own result, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, written
from .op4_urls import parsed

#: Pages of a host from which its wrapper is induced.
SAMPLE_PAGES = 4
#: Distinct pages of a host that must share a run of text before it is a constant.
LEAST_PAGES = 3
#: Pairs of children beyond which the same match is made by whole rows.
CELLS = 40_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: For pages whose quotes don't end: a tag ends at the next ``>``.
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>", re.S)
ATTR = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template xmp iframe".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr #".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table div section article main body html td th blockquote".split())
#: Elements that never hold main text.
DROP = set("nav footer aside form script style noscript template textarea title head button select option svg iframe object canvas dialog menu".split())
#: Words of class, id or role that mark the same, and those that do so only in a block that the host repeats.
STRONG = set("nav navbar navigation menu menubar sidebar footer masthead advert advertisement advertising sponsored cookie cookies consent gdpr popup modal comments disqus newsletter breadcrumb breadcrumbs pagination pager toolbar complementary contentinfo ad ads".split())
WEAK = set("adv side header sponsor promo banner notice alert overlay comment respond replies reply share sharing social subscribe signup login related recommended widget search ad ads".split())
WORD = re.compile(r"[\s_-]+")


def marked(marks: str) -> str:
    """``strong``, ``weak`` or nothing, for the classes, id and role of an element."""
    if not marks:
        return ""
    whole = marks.lower().split()
    if any(w in STRONG for w in whole):
        return "strong"
    parts = [p for w in whole for p in WORD.split(w)]
    if any(p in STRONG and p not in WEAK for p in parts):
        return "strong"
    return "weak" if any(p in WEAK for p in parts) else ""


class Node:
    __slots__ = ("tag", "marks", "kids", "text", "key", "shape", "size", "path")

    def __init__(self, tag: str, marks: str = "", text: str = ""):
        self.tag, self.marks, self.text, self.kids, self.key, self.path = tag, marks, text, [], 0, 0


def walk(root: Node) -> list[Node]:
    """All nodes, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out


def shaped(root: Node) -> Node:
    """Sets a hash of the tags below each node, and their number."""
    for node in reversed(walk(root)):
        node.size = 1 + sum(k.size for k in node.kids)
        node.shape = hash((node.tag, tuple([k.shape for k in node.kids])))
    return root


def tree(page: str) -> Node:
    """A forgiving DOM: unclosed paragraphs and items end where the next begins."""
    root = Node("html")
    stack, at, n, token, opened = [root], 0, len(page), TOKEN, {"html": 1}
    final = page.rfind(">")  # no tag ends behind it

    def shut(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def add(raw: str, decode: bool = True) -> None:
        if raw:
            text = entities.unescape(raw) if decode and "&" in raw else raw
            stack[-1].kids.append(Node("#", text=text))

    while at < n:
        to = page.find("<", at)
        if to < 0 or to > final and not page.startswith(("<!--", "<![CDATA["), to):
            add(page[at:])
            break
        m = token.match(page, to)
        if not m and token is TOKEN and page[to + 1 : to + 2].isalpha():
            token = LOOSE
            m = token.match(page, to)
        if not m:
            add(page[at : to + 1], False)
            at = to + 1
            continue
        add(page[at:to])
        at = m.end()
        tag = m["tag"]
        if not tag:
            add(m["cdata"] or "", False)
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    shut(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in CLOSES or tag not in INLINE:
            ends = CLOSES.get(tag, set()) | (set() if tag in VOID else {"p"})
            for k in range(len(stack) - 1, 0, -1) if any(opened.get(e) for e in ends) else ():
                if stack[k].tag in ends:
                    shut(k)
                    break
                if stack[k].tag in SCOPE and stack[k].tag not in ends:
                    break
        attrs = m["attrs"]
        marks = " ".join(v for a in ATTR.findall(attrs) for v in a[1:] if v) if attrs and len(attrs) > 3 else ""
        node = Node(tag, marks)
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def key_of(text: str) -> int:
    return zlib.crc32(" ".join(text.split()).encode()) + 1


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Matched nodes of two shaped trees by simple tree matching."""
    # by both shapes: the size, and the places of the kids that match
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def middle(x: Node, y: Node) -> tuple[int, int, int]:
        """Children with equal shapes at both ends, and the ends of what is between."""
        low, n, m = 0, len(x.kids), len(y.kids)
        while low < min(n, m) and x.kids[low].shape == y.kids[low].shape:
            low += 1
        while min(n, m) > low and x.kids[n - 1].shape == y.kids[m - 1].shape:
            n, m = n - 1, m - 1
        return low, n, m

    def best(x: Node, y: Node, asked: list) -> tuple[int, list] | None:
        """Size of the largest match of two trees, and the pairs of kids in it; None if other pairs come first."""
        low, n, m = middle(x, y)
        pairs = [(k, k) for k in range(low)] + [(n + k, m + k) for k in range(len(x.kids) - n)]
        size = 1 + sum(x.kids[i].size for i, _ in pairs)
        xs, ys = x.kids[low:n], y.kids[low:m]
        kinds, others = {p.shape: p for p in xs}, {q.shape: q for q in ys}
        need = [(p, q) for p in kinds.values() for q in others.values() if p.tag == q.tag and p.shape != q.shape and (p.shape, q.shape) not in known]
        if need:
            asked += need
            return None
        weight = lambda p, q: p.size if p.shape == q.shape else known[p.shape, q.shape][0] if p.tag == q.tag else 0
        most, more = (match_long if len(xs) * len(ys) > CELLS else match_short)(xs, ys, weight)
        return size + most, pairs + [(low + i, low + j) for i, j in more]

    todo = [(a, b)] if a.tag == b.tag and a.shape != b.shape else []
    while todo:
        x, y = todo[-1]
        asked: list = []
        got = known.get((x.shape, y.shape)) or best(x, y, asked)
        if got is None:
            todo += asked
        else:
            known[x.shape, y.shape] = got
            todo.pop()
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.tag == y.tag:
            out.append((x, y))
            todo += zip(x.kids, y.kids, strict=True) if x.shape == y.shape else [(x.kids[i], y.kids[j]) for i, j in known[x.shape, y.shape][1]]
    return out


def match_short(xs: list[Node], ys: list[Node], weight) -> tuple[int, list[tuple[int, int]]]:
    """Weight of the best match in order of two lists, and its places from the last on."""
    rows = [[0] * (len(ys) + 1)]
    for p in xs:
        row, prev = [0], rows[-1]
        for j, q in enumerate(ys):
            row.append(max(row[j], prev[j + 1], prev[j] + weight(p, q)))
        rows.append(row)
    i, j, more = len(xs), len(ys), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            more.append((i, j))
    return rows[-1][-1], more


def match_long(xs: list[Node], ys: list[Node], weight) -> tuple[int, list[tuple[int, int]]]:
    """The same match for long lists: weights by shape, whole rows at once, and two bits a pair for the way back."""
    others = {q.shape: q for q in ys}
    place = {shape: k for k, shape in enumerate(others)}
    code, of = np.array([place[q.shape] for q in ys]), {}
    prev, up, left = np.zeros(len(ys) + 1, np.int64), [], []
    for p in xs:
        if p.shape not in of:
            of[p.shape] = np.array([weight(p, q) for q in others.values()], np.int64)
        row = np.zeros_like(prev)
        row[1:] = np.maximum.accumulate(np.maximum(prev[1:], prev[:-1] + of[p.shape][code]))
        up.append(np.packbits(row[1:] == prev[1:]))
        left.append(np.packbits(row[1:] == row[:-1]))
        prev = row
    bit = lambda bits, j: bits[j >> 3] >> (7 - (j & 7)) & 1
    i, j, more = len(xs), len(ys), []
    while i and j:
        if bit(up[i - 1], j - 1):
            i -= 1
        elif bit(left[i - 1], j - 1):
            j -= 1
        else:
            i, j = i - 1, j - 1
            more.append((i, j))
    return int(prev[-1]), more


def skeleton(root: Node) -> Node:
    """A copy with hashes of the texts, without scripts and styles."""
    top = Node(root.tag)
    todo = [(root, top)]
    while todo:
        node, copy = todo.pop()
        if node.tag == "#" and node.text.strip():
            copy.key = key_of(node.text)
        for k in node.kids:
            if k.tag not in ("script", "style"):
                copy.kids.append(Node(k.tag))
                todo.append((k, copy.kids[-1]))
    return shaped(top)


def flat(root: Node) -> list:
    """Tags, constants and numbers of children of the nodes, each before its children."""
    return [[n.tag, n.key, len(n.kids)] for n in walk(root)]


def unflat(rows: list) -> Node:
    top = Node("")
    todo = [[top, 1]]
    for tag, key, kids in rows:
        while not todo[-1][1]:
            todo.pop()
        node = Node(tag)
        node.key = key
        todo[-1][0].kids.append(node)
        todo[-1][1] -= 1
        todo.append([node, kids])
    return shaped(top.kids[0])


def wrapper(pages: list[str]) -> list | None:
    """The tree that matches the others best, with constants where half of them agree; None without a second different page.

    Of pages that share the longest part of their text one is taken, so that copies don't vote."""
    trees: list[Node] = []
    seen: set[int] = set()
    for page in pages:
        t = tree(page)
        own = runs_of(t)
        longest = {key for _, key, size, _ in own if size == max(x[2] for x in own)}
        if not own or not longest & seen:
            seen |= longest
            trees.append(shaped(t))
    if len(trees) < 2:
        return None
    best: tuple[int, Node, list] | None = None
    for k, t in enumerate(trees):
        base = skeleton(t)
        pairs = [align(o, base) for o in trees[:k] + trees[k + 1 :]]
        size = sum(map(len, pairs))
        if best is None or size > best[0]:
            best = size, base, pairs
    _, base, pairs = best
    votes: dict[int, int] = {}
    for own in pairs:
        for x, y in own:
            if x.tag == "#" and y.key and key_of(x.text) == y.key:
                votes[id(y)] = votes.get(id(y), 0) + 1
    for y in walk(base):
        if 2 * votes.get(id(y), 0) < len(pairs):
            y.key = 0
    return flat(base)


def runs_of(root: Node, keyed: bool = True) -> list[tuple[int, int, int, list[Node]]]:
    """``(path, key, size, text nodes)`` of each run of text that no block element interrupts."""
    out: list = []
    todo: list = [(root, 0)]
    while todo:
        block, path = todo.pop()
        run: list[Node] = []

        def end() -> None:
            text = " ".join("".join(n.text if n.tag == "#" else " " for n in run).split())
            if text:
                key = hashlib.blake2b(f"{path} {text}".encode("utf-8", "replace"), digest_size=8).digest() if keyed else b""
                out.append((path, int.from_bytes(key, "little", signed=True), len(text), [n for n in run if n.tag == "#"]))
            run.clear()

        inner = list(reversed(block.kids))
        while inner:
            k = inner.pop()
            if k.tag == "#" or k.tag == "br":
                run.append(k)
            elif k.tag in INLINE:
                inner += reversed(k.kids)
            else:
                end()
                k.path = zlib.crc32(f"/{k.tag} {k.marks}".encode("utf-8", "replace"), path)
                todo.append((k, k.path))
        end()
    return out


def constants(rows: DataFrame, html: str) -> DataFrame:
    """``(host, constants, repeated)``, from all pages of a host: keys of the runs that distinct pages share, and
    paths of blocks with weak marks that two pages have, or its only page."""

    def run(batches):
        kind = pa.list_(pa.struct([("path", pa.int64()), ("key", pa.int64()), ("size", pa.int32())]))
        for b in batches:
            own, weak = [], []
            for page in b.column(1).to_pylist():
                root = tree(page or "")
                own.append(list({k: {"path": p, "key": k, "size": n} for p, k, n, _ in runs_of(root)}.values()))
                weak.append(sorted({n.path for n in walk(root) if n.marks and marked(n.marks) == "weak"}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, kind), pa.array(weak, pa.list_(pa.int64()))], ["host", "runs", "weak"])

    pages = written(rows.select("host", html).mapInArrow(lean(run), "host string, runs array<struct<path:bigint,key:bigint,size:int>>, weak array<long>"), "page-runs")
    n_pages = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    weak = pages.select("host", F.explode("weak").alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    weak = weak.join(n_pages, "host").where("n >= 2 or n_pages = 1").groupBy("host").agg(F.collect_list("path").alias("repeated"))
    paths = lambda c: F.array_distinct(F.transform(c, lambda r: r["path"]))
    by_path = pages.select("host", F.explode(paths("runs")).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    by_key = pages.select("host", F.inline("runs")).groupBy("host", "path", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_PAGES)
    often = by_key.join(by_path, ["host", "path"]).where("2 * c >= n").groupBy("host").agg(F.collect_list("key").alias("often"))
    # pages that share their longest other run, or most of their text, are copies and have one vote
    top = lambda c: F.array_max(F.transform(c, lambda r: F.struct(r["size"], r["key"])))
    is_often = lambda r: F.array_contains("often", r["key"])
    rows = pages.join(often, "host").select("host", "runs", F.filter("runs", is_often).alias("shared"), F.filter("runs", lambda r: ~is_often(r)).alias("rest"))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, r: n + r["size"])
    vote = F.xxhash64(F.when(2 * size("rest") >= size("runs"), top("rest")).otherwise(top("runs")))
    rows = written(rows.select("host", paths("runs").alias("paths"), "shared", vote.alias("vote")), "votes")
    d = rows.select("host", "vote", F.inline("shared")).select("host", "path", "key", "vote").distinct().groupBy("host", "path", "key").agg(F.count(F.lit(1)).alias("d"))
    m = rows.select("host", "vote", F.explode("paths").alias("path")).join(d.select("host", "path").distinct(), ["host", "path"], "left_semi").distinct()
    m = m.groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"))
    found = d.join(m, ["host", "path"]).where((F.col("d") >= LEAST_PAGES) & (2 * F.col("d") >= F.col("m")))
    found = found.groupBy("host").agg(F.collect_list("key").alias("constants"))
    return written(found.join(weak, "host", "full"), "constants")


def main_text(page: str | None, wrap: Node | None, fixed: frozenset = frozenset(), repeated: frozenset = frozenset()) -> str:
    root = tree(page or "")
    constant: set[int] = set()
    if wrap:
        constant = {id(x) for x, y in align(shaped(root), wrap) if x.tag == "#" and y.key and key_of(x.text) == y.key}
    # a run is template as a whole: words that running text has in common are none
    fits = lambda nodes: all(id(n) in constant for n in nodes if n.text.strip())
    template = {id(n) for _, key, _, nodes in runs_of(root, bool(fixed)) if key in fixed or fits(nodes) for n in nodes}

    def dropped(node: Node, inside: bool) -> bool:
        if node.tag in DROP or node.tag == "header" and not inside:
            return True
        if not node.marks or node.tag in ("html", "body", "main") or node.tag == "article" and not inside:
            return False
        found = marked(node.marks)
        return found == "strong" or found == "weak" and (node.path in repeated or node.path == 0)

    def find(tag: str) -> list[Node]:
        out, todo = [], list(reversed(root.kids))
        while todo:
            k = todo.pop()
            if k.tag == tag:
                out.append(k)
            elif k.tag != "#" and not dropped(k, False):
                todo += reversed(k.kids)
        return out

    def weight(tops: list[Node]) -> int:
        """Letters of the text below, without what markup drops."""
        total, todo = 0, list(tops)
        while todo:
            k = todo.pop()
            if k.tag == "#":
                total += len("".join(k.text.split()))
            else:
                todo += [x for x in k.kids if x.tag == "#" or not dropped(x, True)]
        return total

    tops, mains = find("article"), find("main")
    if not tops or mains and 2 * weight(tops) < weight(mains):
        tops = mains  # articles that hold the lesser part of it are cards beside the text
    inside, first = bool(tops), {id(t) for t in tops}
    out: list[str] = []
    todo: list = list(reversed(tops or [root]))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag == "#":
            out.append(" " if id(node) in template else node.text)
        elif id(node) in first or not (dropped(node, inside) or (inside and node.tag == "article")):
            space = "" if node.tag in INLINE else " "
            todo += [space, *reversed(node.kids), space]
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = parsed(pages.select(key, url, html), url).drop("path")
    picks = [F.min(F.struct(F.xxhash64(F.col(key), F.col(url), F.length(html), F.lit(k)).alias("h"), F.xxhash64(F.col(key), F.col(url), F.length(html)).alias("row"))).alias(f"p{k}") for k in range(sample)]
    picked = rows.groupBy("host").agg(*picks)
    picked = picked.select(F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.row") for k in range(sample)]))).alias("row")).distinct()
    picked = written(picked, "picked-pages")

    def induce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(html)
        wrap = wrapper([x or "" for x in pdf[html]])
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrap": [zlib.compress(json.dumps(wrap).encode())]})

    chosen = rows.withColumn("row", F.xxhash64(F.col(key), F.col(url), F.length(html))).join(picked, "row").select("host", html)
    chosen = chosen.dropDuplicates()
    wrappers = written(chosen.groupBy("host").applyInPandas(induce, "host string, wrap binary"), "wrappers")

    def unwrapped(wrap: bytes | None) -> Node | None:
        rows = json.loads(zlib.decompress(wrap)) if wrap else None
        return unflat(rows) if rows else None

    def run(batches):
        known: dict[bytes, Node | None] = {}
        for b in batches:
            texts = []
            for page, wrap, own, weak in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if wrap not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrap] = unwrapped(wrap)
                texts.append(main_text(page, known[wrap], frozenset(own or ()), frozenset(weak or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = rows.join(wrappers, "host", "left").join(constants(rows, html), "host", "left").select(key, url, html, "wrap", "constants", "repeated")
    return rows.mapInArrow(lean(run), f"key {kinds[key]}, url {kinds[url]}, text string, n_chars long").toDF(key, url, "text", "n_chars")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html": op5_html}
ORACLES: dict[str, str] = {}
