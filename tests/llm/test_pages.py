import random
import time
from collections import defaultdict

import pytest

from claimloom.llm import pages

KEPT = {
    "<article><p>one</p><button>x<p>two</p><p>three</p></article>": ["one", "x", "two", "three"],
    "<article><p>one</p><video>x<p>two</p></article><video>y</video><button>ok</button>": ["one", "x", "two"],
    "<article><p>a</p><textarea>x<p>two</p></article><textarea>y</textarea>": ["a", "x", "two"],
    "<article><p>a</p><select><option>1</select><button>send</button><p>b</p></article>": ["a", "b"],
    "<article><p>two <math>x</math> end</p><svg><title>i</title></svg></article>": ["two x end"],
    "<article>e<template><div>no</div></template>f</article>": ["ef"],
    '<article><p>a</p><div class="share-price">prices fell</div><section class="related-work">work</section></article>': ["a", "prices fell", "work"],
    '<article><p>a</p><div class="share-buttons">tweet</div><div class="ad">buy</div><div class="article-comments">hm</div></article>': ["a"],
    '<article>a</article><script src="a.js"/>var x=1;</script>': ["a"],
    '<script src="a.js"/><article>b</article><script>1</script>': ["b"],
    "<article>c<script>var<p>d</p></article>": ["c", "d"],
}


@pytest.mark.parametrize("source", KEPT)
def test_an_element_that_is_not_closed_or_named_alike_hides_nothing(source):
    assert pages.main_blocks(source, None) == KEPT[source]


@pytest.mark.parametrize("source", [
    "<div class=x>" * 20000 + "<p>t</p>", "<div class=x><p>t</p>" * 30000, "<article>" + "<button>x" * 20000 + "</article><button>z</button>",
    "<p>a</div>" * 40000, "<script/>" * 20000, "<textarea" * 30000, "<div><button></div>" * 20000 + "</button>"])
def test_long_and_deep_pages_take_time_in_proportion(source):
    start = time.time()
    pages.main_blocks(source, None)
    assert time.time() - start < 10
    assert max(len(c.path) for c in pages.read(source).containers) == 24 or "<div" not in source


def brute_templates(rows):
    """Main container and template tokens from explicit occurrence vectors over the different pages of a host."""
    hosts = defaultdict(dict)
    for host, source in rows:
        page = pages.read(source)
        kept = [(i, text, linked) for i, text, linked in page.blocks if not page.around(i)]
        name = tuple([t for i, t, _ in kept if page.article(i)] or [t for _, t, _ in kept])
        tokens = defaultdict(lambda: [0, 0])
        tokens[("page",)] = [1, 0]
        for i, c in enumerate(page.containers[1:], 1):
            if not page.around(i):
                tokens[("c", c.path)][0] += 1
        for i, text, linked in kept:
            tokens[("b", pages.block_token(page.containers[i].path, text))][0] += 1
            while i > 0:
                tokens[("c", page.containers[i].path)][1] += len(text) - linked
                i = page.containers[i].parent
        hosts[host].setdefault(name, tokens)
    out = {}
    for host, kinds in hosts.items():
        if len(kinds) < pages.HOST_PAGES:
            continue
        vectors = {t: tuple(k[t][0] if t in k else 0 for k in kinds.values()) for k in kinds.values() for t in k}
        classes = defaultdict(set)
        for t, v in vectors.items():
            classes[v].add(t)
        valid = {t for v, of in classes.items() if len(of) >= pages.CLASS_TOKENS and sum(x > 0 for x in v) >= pages.COVER * len(kinds) for t in of}
        chars = {t: sum(k[t][1] for k in kinds.values() if t in k) for t in valid if t[0] == "c" and max(vectors[t]) == 1}
        best = max(chars.values(), default=0)
        main = max((t[1] for t, n in chars.items() if n >= 0.8 * best and n > 0), default=None)
        fixed = {t[1] for t in valid if t[0] == "b"}
        sure = {x for x in fixed if len(kinds) >= pages.SURE_PAGES and set(vectors[("b", x)]) == {1}}
        out[host] = main, fixed, sure
    return out


def test_templates_equal_explicit_occurrence_vectors(spark):
    rng, rows = random.Random(3), []
    for host, n in (("a.com", 12), ("b.com", 4), ("c.com", 2), ("d.com", 9)):
        for k in range(n):
            inner = "".join(f"<p>{' '.join(rng.choice('red green blue grey pink'.split()) + str(rng.randrange(60)) for _ in range(9))}</p>" for _ in range(rng.randrange(1, 5)))
            box = f'<article><p>Always here</p>{inner}</article>' if host == "d.com" else f'<div class="text"><p>Always here</p>{inner}</div>'
            extra = "<section><p>Some offers</p></section>" if rng.random() < 0.7 else ""
            rows.append((host, f'<html><body><nav>menu</nav><div id="wrap"><p>Slogan</p><p>Second</p>{box}{extra}</div><footer>end</footer></body></html>'))
    rows += rows[:6]
    got = {r["host"]: (r["main"], set(r["fixed"] or ()), set(r["sure"] or ())) for r in pages.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    want = brute_templates(rows)
    assert set(got) == set(want) == {"a.com", "b.com", "d.com"} and any(v[1] for v in want.values()) and want["d.com"][2]
    assert got == want
