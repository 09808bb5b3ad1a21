"""Ratios decide what a page's text is; the choice against a version that takes each block's path for itself."""

import random
from collections import Counter, defaultdict
from math import log2

import pytest

from lintlake.llm import html_extract as H


def brute_choose(paths, found):
    """Every sum by a walk over all blocks, every region by walks up to the root."""
    up = lambda p: [p, *up(paths.parent[p])] if p > 0 else [0]
    score = {}
    fused = {}
    for p in {f[0] for f in found}:
        own = [(t, k) for q, t, k in found if q == p]
        chars, marks = sum(len(t) for t, _ in own), sum(len(H.MARKS.findall(t)) for t, _ in own)
        fused[p] = (chars / len(own) * (1 + marks / len(own))) ** 0.5
    for p in fused:
        near = []
        for i, (q, _, _) in enumerate(found):
            if q == p:
                a, c = found[max(0, i - 1)][0], found[min(len(found) - 1, i + 1)][0]
                near.append((fused[a] + 2 * fused[p] + fused[c]) / 4)
        own = [(t, k) for q, t, k in found if q == p]
        score[p] = sum(near) / len(near) * (1 - sum(k for _, k in own) / sum(len(t) for t, _ in own)) ** 3
    weight = Counter()
    for p, text, _ in found:
        weight[p] += len(text) * (H.FURNITURE_WEIGHT if paths.furniture[p] == H.NAMED else 1.0) * score[p]
    every = sum(weight.values())
    named = Counter()
    for p in weight:
        named[next((paths.tag[q] for q in reversed(up(p)) if paths.tag[q] in H.REGION), "")] += weight[p]
    best = max(H.REGION, key=lambda r: named[r])
    held = set()
    if every and named[best] >= H.MOST_OF_IT * every:
        held = {p for p in weight if next((paths.tag[q] for q in reversed(up(p)) if paths.tag[q] in H.REGION), "") == best}
    else:
        below = defaultdict(float)
        for p in weight:
            for q in up(p):
                below[q] += weight[p]
        top = 0
        for p in range(1, len(paths.parent)):
            if paths.parent[p] == top and every and below[p] >= H.MOST_OF_IT * every:
                top = p
        if top in weight:
            top = paths.parent[top]
        if top > 0 and paths.tag[top] not in ("html", "body"):
            held = {p for p in weight if top in up(p)}
    out = []
    least = min(H.LEAST, H.SHORT * log2(1 + (sum(len(f[1]) for f in found) / len(found)) ** 0.5)) if found else 0
    for p, text, _ in found:
        factor = paths.furniture[p] * (H.OUTSIDE if held and p not in held else 1.0)
        if log2(1 + score[p]) * factor >= least:
            out.append(text)
    return out


def random_page(seed):
    r = random.Random(seed)

    def node(depth):
        tag = r.choice(["div", "div", "p", "ul", "article", "main", "section", "h2", "footer", "nav"])
        attributes = r.choice(["", "", ' class="related"', ' class="body"', ' id="comments"', ' role="banner"'])
        inner = "".join(node(depth + 1) for _ in range(r.randrange(0, 4))) if depth < 4 else ""
        text = " ".join(r.choice(["word", "of", "many,", "letters."]) for _ in range(r.choice([0, 1, 5, 40])))
        linked = f'<a href="x">{text}</a>' if r.random() < 0.3 else text
        return f"<{tag}{attributes}>{linked}{inner}</{tag}>"

    return "<html><body>" + "".join(node(0) for _ in range(5)) + "</body></html>"


@pytest.mark.parametrize("seed", range(40))
def test_choice_against_brute_force(seed):
    paths, found = H.blocks(random_page(seed))
    assert H.choose(paths, found) == brute_choose(paths, found)


def test_flat_ratios_change_the_given_pages(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    want = [H.main_text(h) for h in pages]
    assert all(want)
    true = H.ratios
    for wrong in (lambda d: dict.fromkeys(d, 1.0), lambda d: {p: max(d.values()) + min(d.values()) - v for p, v in d.items()}):
        monkeypatch.setattr(H, "ratios", lambda found, wrong=wrong: wrong(true(found)))
        assert sum(H.main_text(h) != w for h, w in zip(pages, want, strict=True)) >= len(pages) / 2


PROSE = "The first sentence of the story, which goes on, says what happened; the second one, shorter, says why. "


def test_furniture_without_names_goes_and_prose_with_a_name_stays():
    page = f"""<html><body><div>Share this page now</div><div><a href="a">One</a> <a href="b">Two</a></div>
    <main><h1>A title of the story</h1><p>{PROSE * 3}</p><p>{PROSE * 2}</p>
    <div class="related"><h2>What came before it</h2><p>{PROSE * 2}</p></div>
    <div class="related links"><ul><li><a href="c">Other story, elsewhere</a></li><li><a href="d">Third story, elsewhere</a></li></ul></div>
    <div class="comments"><p>{PROSE * 2}</p></div></main>
    <div>All rights reserved</div></body></html>"""
    text = H.main_text(page)
    assert text.split("\n") == ["A title of the story", (PROSE * 3).strip(), (PROSE * 2).strip(), "What came before it", (PROSE * 2).strip()]
