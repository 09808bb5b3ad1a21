"""Main text of web pages by tag-path ratios.

A page becomes a row of blocks, each at a path of block elements (tag and class) from the root down to it. Text length, punctuation
and link text are summed by path; a path's length and punctuation per block are fused into one ratio, smoothed over neighbouring blocks,
and damped by the path's share of link text. A path is content if the doublings of its ratio, times two features, reach a threshold:
its names (menus, footers, forms, comments, ... by tag, role, class or id; names that articles use too weigh less there) and its place
(inside the region that holds most of the page's weight: its article or main elements, else the deepest element that holds most of it).
No feature settles a path alone: inside the region a path needs a ratio of 2, outside of it 15, under names of furniture over 10,000;
less on pages whose blocks are but a few letters long.

Parsing and scoring take time and memory in proportion to the page: paths are numbers of a tree, and broken tags are read once.

Defined results: null and empty pages, and pages without content, have an empty text; repeated rows get equal
results; broken markup is read as far as it goes (unclosed elements end with their parent; after a quote that does not end, a tag ends
at its next >); columns besides the page's are carried along, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import text_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
#: The same, when quotes have turned out not to be paired.
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
OPENING = re.compile(r"<(?=/?[a-zA-Z]|[!?])")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no running text.
SILENT = set("head script style noscript template select button textarea iframe svg canvas object audio video map menu input label".split())
OUT = set("nav footer aside form dialog fieldset".split())
OUT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets header masthead topbar footer bottombar comment comments commentlist disqus respond reply replies share sharing social related recommended "
    "newsletter subscribe subscription signup login search pagination pager toolbar skip disclaimer".split()
)
#: Names that mean page furniture around an article, but parts of it within: its header, a notice box, a section on social life.
KEPT_INSIDE = set("header masthead notice notices social skip".split())
#: Names that may head prose of the article; lists of links under them are damped as such.
SOFT_INSIDE = set("related recommended promo promoted share sharing banner widget widgets search alert".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
REGION = ("article", "main")
MARKS = re.compile(r"[.,;:!?…。，、]")

#: Doublings of the ratio that a path must reach, and the factors of its features: furniture by name, by a soft name, outside of the region.
LEAST, NAMED, SOFT, OUTSIDE = 1.6, 0.12, 0.5, 0.4
#: Pages of short blocks: part of the doublings of a block of their mean length, without marks, that is enough.
SHORT = 0.9
#: What a path of furniture weighs where the region is looked for.
FURNITURE_WEIGHT = 0.005
#: Part of the page's weight that a region must hold.
MOST_OF_IT = 0.6


class Paths:
    """Paths as numbers of a tree, 0 for the root: parent, label, factor of its names, and the article or main element it is in."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str, float], int] = {}
        self.parent, self.tag, self.furniture, self.region = [-1], [""], [1.0], [""]

    def down(self, at: int, tag: str, label: str, furniture: float) -> int:
        key = (at, label, furniture)
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(at)
            self.tag.append(tag)
            self.furniture.append(min(furniture, self.furniture[at]))
            self.region.append(self.region[at] or (tag if tag in REGION else ""))
        return self.known[key]


def _named(tag: str, attributes: str, inside: bool) -> tuple[bool, float, str]:
    """(shows nothing, factor of its names, class) of an element; `inside`: it stands in an article or main element."""
    silent, furniture, classes = tag in SILENT, NAMED if tag in OUT or tag == "header" and not inside else 1.0, ""
    if attributes and tag not in ("html", "body", *REGION):
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                silent = True
            elif name == "role":
                furniture = NAMED if value in OUT_ROLES else furniture
            elif name in ("class", "id"):
                words = OUT_NAMES.intersection(re.split(r"[^a-z]+", value)) - (KEPT_INSIDE if inside else set())
                if words:
                    furniture = min(furniture, SOFT if inside and words <= SOFT_INSIDE else NAMED)
                classes = value if name == "class" else classes
    return silent, furniture, classes


def blocks(html: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """(path, text, characters of links) of each block that shows text, in page order."""
    paths, found = Paths(), []
    stack: list[tuple[str, int, bool]] = []  # (tag, path, whether it or an ancestor shows nothing)
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked, link_depth, at, tags = 0, 0, 0, TAG
    here, silent = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((here, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_depth:
                linked += len(text.strip())

    def pop() -> str:
        nonlocal here, silent
        tag, _, _ = stack.pop()
        open_tags[tag] -= 1
        _, here, silent = stack[-1] if stack else ("", 0, False)
        return tag

    last = html.rfind(">")
    while opening := OPENING.search(html, at, last + 1):
        m = tags.match(html, opening.start())
        if m is None and tags is TAG:
            tags = PLAIN_TAG  # a quote does not end: from here on quotes do not count
            m = tags.match(html, opening.start())
        if m is None:  # no tag: a closing slash without a name, say
            say(html[at : opening.end()])
            at = opening.end()
            continue
        say(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in BLOCK or tag in SILENT:
                flush()
                if open_tags[tag]:
                    while pop() != tag:
                        pass
        elif tag in RAW:
            # only its own closing tag ends a raw element; whatever else looks like a tag there is text
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and parts:
                parts.append(" ")
        elif tag == "a":
            link_depth += 1
        elif tag in BLOCK or tag in SILENT:
            flush()
            if tag in BLOCK and stack and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                pop()
            if not m[3].endswith("/") or tag in BLOCK:
                hides, furniture, classes = _named(tag, m[3], bool(paths.region[here]))
                here, silent = paths.down(here, tag, f"{tag}.{classes}", furniture), silent or hides
                stack.append((tag, here, silent))
                open_tags[tag] += 1
    say(html[at:])
    flush()
    return paths, found


def ratios(found: list[tuple[int, str, int]]) -> dict[int, float]:
    """Of each path: characters and marks per block, fused, smoothed over neighbouring blocks, damped by the share of links."""
    chars, marks, links, count = Counter(), Counter(), Counter(), Counter()
    for path, text, linked in found:
        chars[path] += len(text)
        marks[path] += len(MARKS.findall(text))
        links[path] += linked
        count[path] += 1
    fused = {p: (chars[p] / count[p] * (1 + marks[p] / count[p])) ** 0.5 for p in chars}
    row = [fused[path] for path, _, _ in found]
    padded = [row[0], *row, row[-1]] if row else []
    total = Counter()
    for (path, _, _), a, b, c in zip(found, padded, padded[1:], padded[2:], strict=False):
        total[path] += (a + 2 * b + c) / 4
    return {p: total[p] / count[p] * (1 - links[p] / chars[p]) ** 3 for p in count}


def region(paths: Paths, weight: dict[int, float]) -> set[int]:
    """Paths inside the element that holds most of the page's weight; empty if that is only the page itself."""
    every = sum(weight.values())
    named = Counter()
    for p, w in weight.items():
        named[paths.region[p]] += w
    best = max(REGION, key=lambda r: named[r])
    if every and named[best] >= MOST_OF_IT * every:
        return {p for p in weight if paths.region[p] == best}
    below = [0.0] * len(paths.parent)
    for p in range(len(below) - 1, 0, -1):
        below[p] += weight.get(p, 0)
        below[paths.parent[p]] += below[p]
    top = 0
    for p in range(1, len(below)):  # children have higher numbers than their parents
        if paths.parent[p] == top and every and below[p] >= MOST_OF_IT * every:
            top = p
    if top in weight:  # a text's own element is no region
        top = paths.parent[top]
    if top <= 0 or paths.tag[top] in ("html", "body"):
        return set()
    inside = [False] * len(below)
    for p in range(1, len(below)):
        inside[p] = p == top or inside[paths.parent[p]]
    return {p for p in weight if inside[p]}


def choose(paths: Paths, found: list[tuple[int, str, int]]) -> list[str]:
    """Texts of the blocks whose paths are content."""
    score = ratios(found)
    weight: Counter[int] = Counter()
    for p, text, _ in found:
        weight[p] += len(text) * (FURNITURE_WEIGHT if paths.furniture[p] == NAMED else 1.0)
    held = region(paths, {p: weight[p] * score[p] for p in score})
    mean = sum(len(text) for _, text, _ in found) / max(len(found), 1)
    least = min(LEAST, SHORT * log2(1 + mean**0.5))
    kept = {p for p in score if log2(1 + score[p]) * paths.furniture[p] * (OUTSIDE if held and p not in held else 1.0) >= least}
    return [text for p, text, _ in found if p in kept]


def main_text(html: str | None) -> str:
    return "\n".join(choose(*blocks(html or "")))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points)."""
    text_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def of(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html], dtype=object)

    kept = pages if html_col in ("text", "n_chars") else pages.drop("text", "n_chars")
    return kept.withColumn("text", of(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
