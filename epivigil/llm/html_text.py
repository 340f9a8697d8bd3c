"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one for each block of the page, in order); scripts, styles and blocks whose tag, role, class or id
says that they are not the article (menus, footers, adverts, comments and so on) give no line, unless they hold the article. Pages
are judged by the distribution, the text lengths of ``WINDOW`` lines from each line on: a run of text goes from the line where it
surges above the threshold to the line after which it dives below. The heaviest run has a container, the innermost element that holds
most of it; the text is all runs of that container, and its short lines around them, if not all in links (of a whole page, only those
between and after them). Where the text surges in ``article`` or ``main`` elements, lines outside them do not count.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW, SURGE = 3, 86

# Elements of HTML by their part in a page.
HIDDEN = ("script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "title", "textarea", "select", "option", "audio", "video", "map")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CHROME = frozenset(("head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "datalist"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
))
LINES = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "summary", "caption", "legend"))
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
CHROME_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"))
CHROME_WORDS = frozenset((
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pagination", "paywall", "popup",
    "promo", "promotion", "related", "replies", "reply", "respond", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar",
))
DISCUSSION = frozenset(("comment", "comments", "disqus", "replies", "reply", "respond"))

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})>", re.S | re.I)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in CHROME or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _NAMES.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in CHROME_ROLES:
            return True
        if name in ("class", "id") and not CHROME_WORDS.isdisjoint(p.lower() for p in _PARTS.findall(value)):
            return True
    return False


class Lines:
    """The lines of a page that may be part of the article, and the tree of its elements (parents come before their children)."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.weight: list[int] = []  # characters outside links
        self.inside: list[bool] = []  # in an article or main element
        self.heading: list[bool] = []
        self.leaf: list[int] = []  # the innermost block
        self.parent: list[int] = [-1]
        self.piece: list[tuple[int, str, str] | None] = [None]  # parent, tag and attributes of what may be one of several like pieces
        self.whole: set[int] = {0}  # elements that are the page
        self.lines: set[int] = set()  # elements that hold one line by HTML's rules, whatever an unclosed tag puts into them
        self.hider: list[int] = []  # the innermost element that hides the line; dropped by ``shown``


def lines_of(page: str) -> Lines:
    """A line for each block with text that no menu, footer, advert and so on holds."""
    out = Lines()
    open_: list[tuple[str, int, int, int]] = []  # open elements: tag, own number or -1, innermost block, innermost element that hides
    hiders: dict[int, list] = {}  # number: the next one outside, is beside a text by its kind, articles, mains, first headings
    article = links = 0
    heading = False
    text: list[tuple[int, str, bool]] = []  # hider, piece, in a link
    block = hider = 0

    def end_line() -> None:
        parts: dict[int, list[tuple[str, bool]]] = {}
        for by, piece, linked in text:
            parts.setdefault(by, []).append((piece, linked))
        for by, pieces in parts.items():
            line = " ".join(html.unescape("".join(x for x, _ in pieces)).split())
            if line:
                out.text.append(line)
                out.weight.append(max(0, len(line) - 2 * sum(len(x) for x, linked in pieces if linked)))
                out.inside.append(article > 0)
                out.heading.append(heading)
                out.leaf.append(block)
                out.hider.append(by)
        text.clear()

    def leave() -> None:
        nonlocal article, links, block, hider
        name = open_.pop()[0]
        block, hider = open_[-1][2:] if open_ else (0, 0)
        article -= name in ("article", "main")
        links -= name == "a"

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append((hider, page[at : m.start()], links > 0))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end_line()
        elif tag == "br":
            text.append((hider, " ", False))
        if m[2]:
            if any(x[0] == tag for x in open_):
                while open_[-1][0] != tag:
                    leave()
                leave()
            heading = False if tag in ("h1", "h2", "h3") else heading
            continue
        while open_ and open_[-1][0] in CLOSES.get(tag, ("p",) if tag in BLOCKS else ()):
            leave()
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        hides, number = _is_chrome(tag, m[4], article > 0), -1
        if hides or tag in BLOCKS:
            number = len(out.parent)
            out.parent.append(block)
            alike = tag == "section" or tag == "div" and m[4].strip()
            out.piece.append((block, tag, m[4].strip() if tag == "div" else "") if alike else None)
            if tag in ("html", "body"):
                out.whole.add(number)
            elif tag in LINES:
                out.lines.add(number)
        if hides:
            hiders[number] = [hider, tag in ("footer", "nav") or not DISCUSSION.isdisjoint(p.lower() for p in _PARTS.findall(m[4])), 0, 0, 0]
            hider = number
        if hider:
            of = hiders[hider]
            of[2] += tag == "article"
            of[3] += tag == "main"
            of[4] += tag == "h1"
        block = number if tag in BLOCKS else block
        open_.append((tag, number, block, hider))
        article += tag in ("article", "main")
        links += tag == "a"
        heading = tag in ("h1", "h2", "h3") or heading and tag not in BLOCKS
    text.append((hider, page[at:], links > 0))
    end_line()
    _shown(out, hiders)
    return out


def _shown(lines: Lines, hiders: dict[int, list]) -> None:
    """Drop the lines that an element hides, but none for an element that holds the article.

    That is one with a main element, with article elements that hold at least as much text as stands outside, or with most of the
    page's text: the first heading too, or over four times what stands outside (a discussion, menu or footer only where nothing does).
    """
    own = dict.fromkeys((0, *hiders), 0)
    for h, weight in zip(lines.hider, lines.weight):
        own[h] += weight
    outside = {0: 0}
    for h, (up, *_) in hiders.items():
        outside[h] = outside[up] + own[up]
    held, kept = dict(own), {0: True}
    for h, (up, beside, articles, mains, first) in reversed(hiders.items()):
        most = held[h] >= SURGE and held[h] > outside[h] and (first or held[h] > 4 * outside[h]) and not (beside and outside[h])
        kept[h] = bool(mains or articles and held[h] >= outside[h] or most)
        if kept[h] and up:
            held[up] += held[h]
            for k, n in ((2, articles), (3, mains), (4, first)):
                hiders[up][k] += n
    for h, (up, *_) in hiders.items():
        kept[h] = kept[h] and kept[up]
    for name in ("text", "weight", "inside", "heading", "leaf", "hider"):
        setattr(lines, name, [x for x, h in zip(getattr(lines, name), lines.hider) if kept[h]] if name != "hider" else [])


def _container(lines: Lines, weight: np.ndarray, a: int, b: int) -> tuple[int, int, bool]:
    """The lines (from, up to; and whether it is the whole page) of the innermost element around blocks that holds most of the text of the lines from a up to b.

    Several sections, or several divs with the same attributes, beside each other are pieces of one text and not its container.
    """
    n = len(lines.parent)
    held, around, first, last = [0.0] * n, [False] * n, [len(lines.text)] * n, [-1] * n
    for i, leaf in enumerate(lines.leaf):
        first[leaf], last[leaf] = min(first[leaf], i), max(last[leaf], i)
        if a <= i < b:
            held[leaf] += weight[i]
            around[max(0, lines.parent[leaf])] = True
    for e in range(n - 1, 0, -1):
        up = lines.parent[e]
        held[up] += held[e]
        around[up] = around[up] or around[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
    alike = Counter(p for p, x in zip(lines.piece, last) if p and x >= 0)
    e = max(e for e in range(n) if e == 0 or around[e] and e not in lines.lines and 2 * held[e] > held[0] and alike[lines.piece[e]] < 2)
    return first[e], last[e] + 1, e in lines.whole


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends; an empty text for a null page or one without text."""
    lines = lines_of(page or "")
    n = len(lines.text)
    weight = np.array(lines.weight, float)
    sums = np.convolve(weight, np.ones(WINDOW))[WINDOW - 1 :] if n else weight  # of a line and the next ones
    runs, start = [], None
    for i in range(n + 1):
        high = i < n and sums[i] >= SURGE
        if high and start is None and weight[i] > 0:
            start = i
        elif not high and start is not None:  # the dive: the last line with text before it ends the run
            end = i
            while end < n and weight[end] > 0 and sums[end] >= SURGE / 2:
                end += 1
            runs.append((start, end))
            start = None
    if not runs:  # no surge at all: a short page is its own text
        return "\n".join(lines.text)
    inside = np.array(lines.inside)
    if any(inside[a:b].any() for a, b in runs):  # where the text surges in articles, they are its containers
        weight = np.where(inside, weight, 0)
        runs = [r for r in runs if inside[r[0] : r[1]].any()]
    else:
        inside[:] = True
    best = max(runs, key=lambda r: weight[r[0] : r[1]].sum())
    low, high, whole = _container(lines, weight, *best)
    runs = [r for r in runs if r == best or low <= r[0] < high]
    keep = np.zeros(n, bool)
    a, b = runs[0][0], max(r[1] for r in runs)
    low = max(a, low) if whole else low  # a page has its menus in front
    keep[low:high] = (weight > 0)[low:high] | np.array(lines.heading)[low:high]
    while high > b and (lines.heading[high - 1] or not keep[high - 1]):  # headings with nothing below
        high -= 1
        keep[high] = False
    for r in runs:
        keep[r[0] : r[1]] = True
    a = min(a, low)
    while a > 0 and lines.heading[a - 1]:
        a -= 1
        keep[a] = True
    return "\n".join(x for x, k in zip(lines.text, keep & inside) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html; other columns are ignored).

    The whole page is read; a null or empty one has an empty text. Repeated rows are extracted one by one; an empty table gives
    no rows.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(found, pa.string()), "n_chars": np.array([len(t) for t in found], np.int64)})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
