"""Raw elements and names inside an article."""

import pytest

from lintlake.llm import html_extract

BODY = "<p>The first sentence of the story, told at length.</p><p>The second one, no shorter than the first.</p>"
TEXT = "The first sentence of the story, told at length.\nThe second one, no shorter than the first."


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){}</script>", "<SCRIPT>if(a<b)c('<p>')</Script >", "<style>a<b{}</style>", "<title>x<y</title>", "<textarea>x<y 'z</textarea>", "<noscript>x<y</noscript>"])
def test_text_after_a_raw_element_stays(raw):
    assert html_extract.main_text(f"<html><body><article>{raw}{BODY}</article></body></html>") == TEXT


@pytest.mark.parametrize("name", ["article-header", "notice", "social", "skip"])
def test_names_yield_inside_an_article(name):
    page = f'<html><body><article><div class="{name}"><h1>The title of it</h1></div>{BODY}</article></body></html>'
    assert html_extract.main_text(page) == "The title of it\n" + TEXT
    assert html_extract.main_text(f'<html><body><div class="{name}"><h1>No title</h1></div><article>{BODY}</article></body></html>') == TEXT


def test_heaviest_region():
    page = f"<html><body><main>{BODY}</main><article><p>A teaser.</p></article></body></html>"
    assert html_extract.main_text(page) == TEXT


def test_ratios_decide(monkeypatch):
    """Paragraphs and furniture differ by their ratios alone: no name, role or tag tells them apart."""
    links = '<div class="x1"><p><a href="/a">One</a> <a href="/b">Two</a> <a href="/c">Three and four</a></p></div>'
    page = f'<html><body><div class="x2"><p>Buy now</p></div><div class="x3">{BODY}{links}</div></body></html>'
    assert html_extract.main_text(page) == TEXT
    assert html_extract.main_text(f"<html><body><article>{BODY}{links}</article></body></html>") == TEXT
    assert html_extract.main_text(f'<html><body><div class="x2"><p>Buy it now, or never.</p></div><article>{BODY}</article></body></html>') == TEXT
    right = html_extract.ratios
    monkeypatch.setattr(html_extract, "ratios", lambda found: dict(zip(right(found), reversed(list(right(found).values())), strict=True)))
    assert html_extract.main_text(page) != TEXT


def test_ratios_by_hand():
    found = [(1, "One two.", 0), (2, "abcd", 4), (1, "Three, four.", 0), (3, "links here", 5)]
    path = {1: [0, 2], 2: [1], 3: [3]}

    def fused(p):
        own = [found[k] for k in path[p]]
        n, chars = len(own), sum(len(t) for _, t, _ in own)
        marks, links = sum(t.count(".") + t.count(",") for _, t, _ in own), sum(x for *_, x in own)
        return (chars / n * (1 + marks / n)) ** 0.5, 1 - links / chars

    row = [fused(p)[0] for p, *_ in found]
    smooth = [(row[max(k - 1, 0)] + 2 * row[k] + row[min(k + 1, 3)]) / 4 for k in range(4)]
    want = {p: sum(smooth[k] for k in at) / len(at) * fused(p)[1] ** 3 for p, at in path.items()}
    got = html_extract.ratios(found)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and got[2] == 0


@pytest.mark.parametrize("unit", ["<div>x", "<a '", "<a '>'", "<", "<!", "<script>", "<b>x</p>", "<li>x</div>", '<p class="a'])
def test_time_in_proportion(unit):
    import time

    began = time.perf_counter()
    html_extract.main_text(unit * (500_000 // len(unit)))
    assert time.perf_counter() - began < 20
    html_extract.main_text("<div>" * 30_000 + "</p>" * 30_000 + BODY)


def test_regions():
    assert html_extract.main_text(f'<body><div class="page"><div class="left"><p>Aside words</p></div><div class="story">{BODY}<ul><li>a point</li></ul></div></div></body>') == TEXT + "\na point"
    table = "<table><tr><td>12</td><td>13</td></tr></table>"
    assert html_extract.main_text(f"<body><article>{BODY}{table}</article><p>Out</p></body>") == TEXT + "\n12\n13"
    assert html_extract.main_text("<body><footer><p>Only a footer, with a sentence or two in it. Nothing else.</p></footer></body>") == ""
