"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks. Each block has its word count and
link density, those of its neighbours, and whether it stands inside boilerplate
or article markup. A tree trained on the labelled table below keeps or drops it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?|[^<]+|<", re.S)
# Element names and the words in class, id or role that mark boilerplate.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "acronym"}
INLINE |= {"math", "mi", "mo", "mn", "ms", "mtext", "mspace", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "mpadded", "mphantom", "semantics", "annotation"}
# Start tags that end an open svg or math, and the elements inside of which they do not.
BREAKOUT = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
HOSTS = {"foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"}
BOILER = {"svg", "template", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar\w*|footer\w*|header|masthead|breadcrumb\w*|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|social|share\w*|related|recommend\w*|comment|comments|commentlist|disqus|respond|widget\w*|pagination|pager|login|signup|search\w*|copyright|legal|toolbar|contentinfo|navigation|complementary)(?=$|[\s_-])", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story|main|body-text|content)(?=$|[\s_-])", re.I)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Labelled blocks. words and link density before, here, after; in boilerplate; in article; 1 = main text.
LABELLED = np.array([
    [0, 0, 1, 1, 1, 1, 1, 0, 0], [1, 1, 1, 1, 1, 1, 1, 0, 0], [1, 1, 2, 1, 12, 0, 1, 0, 0], [1, 1, 12, 0, 8, 0, 1, 0, 0],
    [40, 0, 3, 0, 0, 0, 1, 0, 0], [60, 0, 25, 0.1, 0, 0, 1, 0, 0], [30, 0, 45, 0, 30, 0, 1, 0, 0], [30, 0, 20, 0, 5, 1, 1, 1, 0],
    [80, 0, 15, 0, 15, 0, 1, 1, 0], [15, 0, 60, 0, 4, 0, 1, 1, 0], [0, 0, 90, 0, 70, 0, 1, 0, 0], [5, 0.5, 110, 0, 2, 0, 1, 1, 0],
    [12, 0, 8, 0, 40, 0, 0, 1, 1], [8, 0, 40, 0, 30, 0, 0, 1, 1], [40, 0, 2, 0, 50, 0, 0, 1, 1], [50, 0, 60, 0.1, 70, 0, 0, 1, 1],
    [3, 1, 5, 0, 3, 0, 0, 1, 1], [90, 0, 30, 0.3, 3, 0, 0, 1, 1], [20, 0, 3, 1, 20, 0, 0, 1, 1], [2, 0, 1, 0, 2, 0, 0, 1, 1],
    [6, 0, 1, 0, 8, 0, 0, 1, 1], [3, 0, 4, 0, 6, 0, 0, 1, 1], [9, 0.2, 2, 0, 3, 0, 0, 1, 1], [1, 1, 3, 0, 9, 0, 0, 1, 1], [8, 0, 2, 0.5, 2, 0, 0, 1, 1], [5, 0, 1, 0, 1, 0, 0, 1, 1],
    [20, 0, 30, 0, 3, 1, 0, 1, 1], [10, 0, 3, 0, 2, 1, 0, 1, 1], [0, 0, 2, 0, 6, 0.8, 0, 1, 1], [5, 0, 12, 0.5, 4, 1, 0, 1, 1], [2, 1, 4, 1, 2, 1, 0, 1, 1], [1, 1, 2, 0.5, 1, 1, 0, 1, 1],
    [0, 0, 1, 0, 0, 0, 0, 1, 1], [1, 1, 25, 0.9, 25, 0, 0, 1, 1], [4, 1, 200, 0, 1, 0, 0, 1, 1], [10, 0, 4, 0.5, 12, 0, 0, 1, 1],
    [0, 0, 60, 0, 50, 0, 0, 0, 1], [50, 0, 45, 0, 60, 0, 0, 0, 1], [60, 0, 30, 0.05, 2, 0, 0, 0, 1], [4, 0, 35, 0, 40, 0, 0, 0, 1],
    [40, 0, 6, 0, 40, 0, 0, 0, 1], [30, 0, 8, 0, 45, 0, 0, 0, 1], [25, 0, 5, 0, 30, 0, 0, 0, 1], [3, 1, 22, 0, 28, 0, 0, 0, 1],
    [1, 1, 2, 1, 30, 0, 0, 0, 0], [2, 1, 3, 1, 40, 0, 0, 0, 0], [3, 1, 1, 1, 20, 0, 0, 0, 0], [1, 1, 2, 1, 0, 0, 0, 0, 0], [30, 0, 6, 1, 50, 0, 0, 0, 0], [30, 0, 4, 0.9, 8, 0, 0, 0, 0],
    [1, 1, 1, 1, 1, 1, 0, 0, 0], [2, 1, 3, 0.9, 2, 1, 0, 0, 0], [4, 1, 12, 0.8, 3, 1, 0, 0, 0], [40, 0, 20, 0.9, 10, 1, 0, 0, 0],
    [5, 0.8, 4, 0, 3, 1, 0, 0, 0], [3, 1, 5, 0, 0, 0, 0, 0, 0], [0, 0, 3, 0, 2, 1, 0, 0, 0], [2, 1, 6, 0.4, 2, 1, 0, 0, 0],
])


def grow(x: np.ndarray, y: np.ndarray, least: int = 2):
    """Gini tree as nested tuples (feature, threshold, low, high) with class leaves."""
    if len(set(y.tolist())) == 1 or len(y) < 2 * least:
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            impurity = sum(m.sum() * p * (1 - p) for m in (low, ~low) for p in [y[m].mean()])
            if min(low.sum(), (~low).sum()) >= least and (best is None or impurity < best[0] - 1e-12):
                best = (impurity, f, float(cut), low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], least), grow(x[~low], y[~low], least)


def verdict(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """Text, words, link density, in boilerplate, in article of each block, in page order."""
    out: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # element, boilerplate depth and article depth that it adds
    text: list[str] = []
    linked, boiler, main, anchors, foreign, at = 0, 0, 0, 0, 0, 0
    ends: dict[str, re.Match | None] = {}  # next end tag of each raw element, None if the rest of the page has none

    def close() -> None:
        nonlocal linked
        flat = " ".join(entities.unescape("".join(text)).split())
        if flat:
            n = len(flat.split())
            out.append((flat, n, min(1.0, linked / n), int(boiler > 0), int(main > 0)))
        text.clear()
        linked = 0

    while m := PART.match(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            part = m[0]
            if part.startswith("<![CDATA["):
                part = part[9:-3]
            elif part.startswith("<") and len(part) > 1:
                continue
            text.append(part)
            if anchors:
                linked += len(part.split())
            continue
        if name not in INLINE:
            close()
        if m[1]:
            if any(s[0] == name for s in stack):
                while stack:
                    top, b, a = stack.pop()
                    boiler, main, anchors, foreign = boiler - b, main - a, anchors - (top == "a"), foreign - (top in ("svg", "math"))
                    if top == name:
                        break
            continue
        if name in RAW:
            if name not in ends or (ends[name] and ends[name].start() < at):
                ends[name] = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            end = ends[name]
            # Closed in itself: void, unless the end tag that follows is its own.
            if m[3].endswith("/") and not (end and not re.compile(rf"<{name}[\s/>]", re.I).search(page, at, end.start())):
                continue
            if end or name != "template":
                at = end.end() if end else len(page)
                continue
        if name in BREAKOUT and foreign:
            while (host := next((s[0] for s in reversed(stack) if s[0] in HOSTS or s[0] in ("svg", "math")), None)) in ("svg", "math"):
                while True:
                    top, b, a = stack.pop()
                    boiler, main, anchors, foreign = boiler - b, main - a, anchors - (top == "a"), foreign - (top in ("svg", "math"))
                    if top == host:
                        break
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "tr", "td", "dd", "dt", "option") and stack and stack[-1][0] == name:
            top, b, a = stack.pop()
            boiler, main = boiler - b, main - a
        hints = " ".join(x[0] or x[1] or x[2] for x in ATTR.findall(m[3]))
        is_main = int(name in ("article", "main") or bool(MAIN.search(hints)))
        is_boiler = int(name in BOILER or (name == "header" and not main) or (name not in ("html", "body", "article", "main") and bool(HINTS.search(hints))))
        stack.append((name, is_boiler, is_main))
        boiler, main, anchors = boiler + is_boiler, main + is_main, anchors + (name == "a")
        foreign += name in ("svg", "math")
    close()
    return out


def main_text(page: str, tree) -> str:
    """Kept blocks joined by one space."""
    found = blocks(page)
    kept = []
    for i, (flat, n, density, boiler, main) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if verdict(tree, (*before, n, density, *after, boiler, main)):
            kept.append(flat)
    return " ".join(kept)


def text_column(page: Column, labelled: np.ndarray = LABELLED) -> Column:
    tree = grow(labelled[:, :-1], labelled[:, -1])

    @pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return extract(F.coalesce(page, F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of `pages`; null or empty html gives an empty text, repeated rows repeat."""
    df = pages.select("page_id", "url", text_column(F.col("html")).alias("text"))
    return df.withColumn("n_chars", F.length("text").cast("long"))
