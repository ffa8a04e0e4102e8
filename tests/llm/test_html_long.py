"""Matches of long lists of children."""

import random

from nextbasket.llm import op5_html


def nodes(r, n):
    top = op5_html.Node("div")
    for _ in range(n):
        kid = op5_html.Node(r.choice("abcd"))
        kid.kids = [op5_html.Node(r.choice("xy")) for _ in range(r.randint(0, 3))]
        top.kids.append(kid)
    return op5_html.shaped(top)


def test_long_lists_are_matched_in_full(monkeypatch):
    r = random.Random(5)
    for n, m in ((260, 250), (300, 210)):
        a, b = nodes(r, n), nodes(r, m)
        got = op5_html.align(a, b)
        monkeypatch.setattr(op5_html, "CELLS", 10**9)
        want = op5_html.align(a, b)
        monkeypatch.undo()
        assert [(id(x), id(y)) for x, y in got] == [(id(x), id(y)) for x, y in want] and len(got) > n // 2
