"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams events; block tags end a line, as no page can be trusted to break its own. Each
line has its text, its tags and the characters inside links. The logarithm of its unlinked characters for each tag is
smoothed with a Gaussian over neighbouring lines (those of another element count little) and split into two clusters;
the upper one marks content. Names of elements and classes weigh a line's ratio: an article's lines in full, those of
elements without a telling name a little less, those of menus, notices, adverts, forms or comments next to nothing.

The content region is found from the marked characters of every element: from the document downwards into the child that
holds most of them, until an article or an element that has marked lines or headings of its own; named content elements are
preferred where they hold most of the marked characters. The text is every marked line of the
region and, between them, the short lines that no cluster can tell apart, unless their names speak against them or, outside
of articles, they are lists of links or hold little beside the rest. Where nothing is marked, there is no text.

One pass in Arrow batches, no shuffle; time is linear in the page, also in its depth: open elements are kept as parent
numbers with inherited marks. Defined cases: null, empty or text-free pages give an empty text; unclosed tags end with the
element around them; character references are decoded; very long and deeply nested pages are read whole; repeated pages
give repeated rows; an empty table gives none. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and class names
SILENT = frozenset("head script style noscript template svg math iframe object select textarea button canvas audio video datalist".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINES = HEADINGS | frozenset("p li dt dd blockquote pre figcaption tr caption summary address hr legend".split())
HOLDERS = frozenset("html body div article main section header ul ol dl table tbody thead tfoot figure details fieldset center".split()) | ASIDE
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ROOTS = frozenset("article main".split())
ROOT_NAMES = frozenset("article articlebody content post entry story main".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar widget widgets related recommended recommendations "
    "trending rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer copyright "
    "share sharing social comment comments reply replies respond disqus login search".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


LISTS = frozenset("ul ol dl table tbody thead tfoot figure details fieldset center".split())
# Weights of a line's ratio by its names, and the weight of a neighbour in another element
IN_ROOT, UNNAMED, NAMED_OTHER, ELSEWHERE = 1.0, 0.8, 0.05, 0.05
LEAST = 1.0  # of a marked line's smoothed logarithm, and of the range that two clusters need
MOST_OF = 0.6  # share of the marked characters that leads into a child
BESIDE = 0.3  # share of the largest child's marked characters under which a nameless child is not content


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    other: bool  # stands in a menu, notice, advert, form, comment, page header or footer
    in_root: bool
    heading: bool
    home: int  # number of the innermost holder, 0 for the document


@dataclass
class Holder:
    """An element that holds lines. All but ``tag``, ``root`` and ``silent`` is inherited from its parents."""

    number: int
    parent: int
    tag: str
    other: bool
    header: bool
    root: bool
    in_root: bool
    silent: bool = False


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    heading: bool = False


class PageLines(HTMLParser):
    """Turns parser events into lines and a tree of holders, whose numbers grow downwards."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.holders = [Holder(0, 0, "", False, False, False, False)]
        self.open = [self.holders[0]]
        self.open_tags: Counter[str] = Counter()
        self.silent = 0
        self.in_link = 0
        self.now = _Open()

    def _end_line(self) -> None:
        text = " ".join("".join(self.now.parts).split())
        if text:
            home = self.open[-1]
            other = home.other or (home.header and not (home.in_root and self.now.heading))
            self.lines.append(Line(text, self.now.tags, self.now.linked, other, home.in_root, self.now.heading, home.number))
        self.now = _Open()

    def _names(self, attrs: dict[str, str | None]) -> list[list[str]]:
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()
        return [[p.lower() for p in _PARTS.findall(n)] for n in names]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self._open(tag, {}, silent=True)
            if tag != "body":
                return
            while len(self.open) > 1 and self.open[-1].tag != "html":  # a head without an end
                self._pop()
        if tag == "br":
            self.now.parts.append(" ")
        elif tag in ("td", "th"):
            self.now.parts.append(" ")
        elif tag in SILENT:
            if tag in ("head",):
                self._end_line()
            self._open(tag, {}, silent=True)
            return
        elif tag in LINES:
            self._end_line()
            self.in_link = 0
            self.now.heading = tag in HEADINGS
        elif tag in HOLDERS:
            self._end_line()
            self.in_link = 0
            self._open(tag, dict(attrs))
        elif tag == "a":
            self.in_link += 1
        self.now.tags += 1

    def _open(self, tag: str, attrs: dict[str, str | None], silent: bool = False) -> None:
        names = self._names(attrs)
        whole = tag in ("html", "body") or tag in ROOTS
        named_other = not whole and any(n and n[0] not in ("has", "with", "no", "is") and OTHER_NAMES.intersection(n) for n in names)
        if tag == "article" and any({"comment", "comments", "reply", "teaser", "related", "sponsored", "promo", "ad"} & set(n) for n in names):
            named_other = True
        role = (attrs.get("role") or "").lower()
        hidden = "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        header = tag == "header" or (named_other and all("header" in n for n in names if OTHER_NAMES.intersection(n)))
        other = tag in ASIDE or (named_other and not header) or role in OTHER_ROLES or hidden
        root = not other and not header and (tag in ROOTS or role in ("main", "article") or any("".join(n) in ROOT_NAMES for n in names))
        up = self.open[-1]
        holder = Holder(len(self.holders), up.number, tag, up.other or other, up.header or header, root, up.in_root or root, silent)
        self.holders.append(holder)
        self.open.append(holder)
        self.open_tags[tag] += 1
        self.silent += silent

    def _pop(self) -> Holder:
        gone = self.open.pop()
        self.open_tags[gone.tag] -= 1
        self.silent -= gone.silent
        return gone

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in HOLDERS or tag in SILENT:
            if self.open_tags[tag]:
                if tag in HOLDERS:
                    self._end_line()
                while self._pop().tag != tag:
                    pass
            return
        if tag in LINES:
            self._end_line()
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)
        self.now.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.now.parts.append(data)
            if self.in_link:
                self.now.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed_ratios(lines: list[Line], spread: float = 1.0) -> np.ndarray:
    """Logarithms of unlinked characters for each tag, weighed by names and smoothed over neighbouring lines."""
    ratio = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines], dtype=float)
    weight = np.array([NAMED_OTHER if x.other else IN_ROOT if x.in_root else UNNAMED for x in lines])
    value = np.log1p(ratio) * weight
    home = np.array([x.home for x in lines])
    total, mass = value.copy(), np.ones(len(lines))
    for step in range(1, min(int(3 * spread), len(lines) - 1) + 1):
        near = np.where(home[step:] == home[:-step], 1.0, ELSEWHERE) * np.exp(-0.5 * (step / spread) ** 2)
        total[step:] += near * value[:-step]
        mass[step:] += near
        total[:-step] += near * value[step:]
        mass[:-step] += near
    return total / mass


def high_cluster(values: np.ndarray) -> np.ndarray:
    """The upper one of two clusters on a line, as far as it reaches the least value of content; near values are one cluster."""
    low, high = float(values.min()), float(values.max())
    if high - low < LEAST:
        return values >= LEAST
    for _ in range(20):
        upper = values >= (low + high) / 2
        if upper.all() or not upper.any():
            break
        low, high = float(values[~upper].mean()), float(values[upper].mean())
    return (values >= (low + high) / 2) & (values >= LEAST)


def content_region(holders: list[Holder], mass: np.ndarray, own: np.ndarray) -> int:
    """The holder of the content: ``mass`` are marked characters below each holder, ``own`` those of its own lines.

    Goes down while one child holds most of the marked characters. Text of its own, or a telling name, keeps a holder,
    unless most of its marked characters stand in one element with a stronger name.
    """
    rank = [0 if not h.root else 3 if h.tag == "article" else 2 if h.tag == "main" else 1 for h in holders]
    # marked characters of the fullest element of a rank or more at or below each holder; rank 0 is the holder itself
    full = np.zeros((4, len(holders)))
    full[0] = [0 if h.tag in LISTS else m for h, m in zip(holders, mass)]
    below: list[list[int]] = [[] for _ in holders]
    for h in reversed(holders[1:]):
        for r in (1, 2, 3):
            full[r, h.number] = max(full[r, h.number], mass[h.number] if rank[h.number] >= r else 0)
            full[r, h.parent] = max(full[r, h.parent], full[r, h.number])
        below[h.parent].append(h.number)
    at = 0
    while rank[at] < 3 and below[at]:
        least = min(3, rank[at] + 1) if own[at] > 0 or rank[at] == 2 else rank[at]
        child = max(below[at], key=lambda n: (full[least, n], -n))
        if full[least, child] < MOST_OF * mass[at]:
            break
        at = child
    return at


def main_text(html: str | None) -> str:
    """The main text: one line for each block of the content region."""
    page = PageLines()
    page.feed(html or "")
    page.close()
    lines, holders = page.lines, page.holders
    if not lines:
        return ""
    marked = high_cluster(smoothed_ratios(lines))
    if not marked.any():
        return ""
    own, mass, every, linked = (np.zeros(len(holders)) for _ in range(4))
    for x, m in zip(lines, marked):
        # a heading marks its element as one that has text of its own, however short it is
        own[x.home] += max(0, len(x.text) - x.linked) * m or (x.heading and not x.other)
        every[x.home] += len(x.text)
        linked[x.home] += x.linked
    mass += own
    for h in reversed(holders[1:]):  # children have greater numbers
        for sums in (mass, every, linked):
            sums[h.parent] += sums[h.number]
    region = content_region(holders, mass, own)
    largest = max((mass[h.number] for h in holders[1:] if h.parent == region), default=0.0)
    inside = np.zeros(len(holders), dtype=bool)
    inside[region] = True
    for h in holders[region + 1 :]:
        keep = inside[h.parent]
        if keep and not h.in_root:
            links = mass[h.number] == 0 and 2 * linked[h.number] >= every[h.number] > 0
            aside = h.parent == region and own[region] == 0 and mass[h.number] < BESIDE * largest
            keep = not (links or aside)
        inside[h.number] = keep
    return "\n".join(x.text for x, m in zip(lines, marked) if inside[x.home] and (m or not x.other))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    found = pages.select("page_id", "url", extract("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
