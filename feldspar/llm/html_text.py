"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read as a flat list of blocks (the text between block-level tags), each with its word count and link density,
those of its two neighbours, whether it is a heading, and what its open elements say (inside an article; inside a menu,
footer, advert, form, comment list or the like).  A decision tree (Gini, grown once from the small labelled table
below) marks the blocks of the main text; they are joined in page order.  Where no element says anything, the
neighbours decide: a short line between paragraphs belongs to them, the same line among links or other short lines
doesn't.

Reading a page takes time in proportion to its length, whatever is in it: tags are matched without backtracking, and
what the open elements say is kept in counters.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Elements by their part in a page.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIP = frozenset("script style noscript template svg iframe canvas textarea select button audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog head title".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments disqus cookie cookies consent dialog disclaimer footer foot gdpr header hidden login masthead menu modal nav navbar navigation navigation notice notices newsletter overlay pager pagination popup promo promotion recommended register related replies responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar widget".split())
#: Words that leave a compound class name such as ad-box or site-footer what its other words make it.
PLAIN_WORDS = frozenset("area bar block body bottom box col column container content form group inner item items left link links list main outer page panel posts right section site top wrap wrapper".split())
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be left out, and those in which one that is still open isn't ended by the next.
IMPLIED = ("p", "li", "td", "tr", "dt", "dd", "option")
BARRIERS = ("ul", "ol", "table", "dl", "div", "section", "blockquote")

#: A tag: name, and attributes whose quoted values may hold ``>``.  Nothing that has matched is given back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(>?)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_NAME = re.compile(r"[A-Za-z][a-z]*+|[A-Z]++|[0-9]++")
_SPACE = re.compile(r"\s+")
_SKIPPED = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in SKIP}


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool
    article: bool
    aside: bool

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


@lru_cache(maxsize=4096)
def names(value: str, in_article: bool) -> tuple[bool, bool]:
    """(article, aside) of a class or id: of its names, one that is an aside word, or whose parts are aside words besides
    plain words and numbers, makes an aside; one that is an article word makes an article.  A header inside an article
    is part of it."""
    article = aside = False
    for token in value.split():
        article |= token.lower() in ARTICLE_WORDS
        parts = {p.lower() for p in _NAME.findall(token)}
        said = (parts & ASIDE_WORDS) - ({"header"} if in_article else set())
        aside |= bool(said) and all(p in said or p in PLAIN_WORDS or p.isdigit() for p in parts)
    return article, aside


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(inside the article, aside) as an element's name and attributes say."""
    article = tag in ("article", "main")
    aside = tag in ASIDE or (tag == "header" and not in_article)
    for m in _ATTRIBUTE.finditer(attributes) if attributes and not attributes.isspace() else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            aside = True
        elif name == "style":
            aside |= "display:none" in value.replace(" ", "").lower()
        elif name in ("class", "id", "role"):
            said = names(value, in_article) if len(value) < 256 else names.__wrapped__(value, in_article)
            aside |= said[1] or (name == "role" and value.lower() in ("navigation", "complementary", "contentinfo", "alert"))
            article |= said[0] and tag in ("div", "section", "td") or (name == "role" and value.lower() == "main")
    return article, aside


class _Open:
    """The open elements of a page, with what they say counted."""

    def __init__(self, page: str):
        self.page = page
        self.unended: dict[str, bool] = {}
        #: Places of asides that may be open only because nobody ended them.
        self.loose: list[int] = []
        self.stack: list[tuple[str, bool, bool]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.asides: list[int] = []
        self.articles: list[int] = []

    def push(self, tag: str, article: bool, aside: bool) -> None:
        i = len(self.stack)
        self.stack.append((tag, article, aside))
        self.at[tag].append(i)
        if article:
            self.articles.append(i)
        if aside:
            self.asides.append(i)
            if self.lacks_ends(tag):
                self.loose.append(i)

    def lacks_ends(self, tag: str) -> bool:
        """Whether the page has fewer end tags than start tags of a block element."""
        if tag not in BLOCK:
            return False
        if tag not in self.unended:
            starts, ends = (sum(1 for _ in re.finditer(rf"<{slash}{tag}(?=[\s/>])", self.page, re.I)) for slash in ("", "/"))
            self.unended[tag] = ends < starts
        return self.unended[tag]

    def pop_to(self, i: int) -> None:
        """Ends the elements from place ``i`` on."""
        while len(self.stack) > i:
            tag, article, aside = self.stack.pop()
            self.at[tag].pop()
            if article:
                self.articles.pop()
            if aside:
                self.asides.pop()
                if self.loose and self.loose[-1] == len(self.stack):
                    self.loose.pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def first(self, *tags: str) -> int | None:
        return min((self.at[t][0] for t in tags if self.at[t]), default=None)


def blocks(page: str) -> list[Block]:
    """The flat list of text blocks that aren't empty.  A tag or comment that never ends takes the rest of the page."""
    out: list[Block] = []
    still = _Open(page)
    parts: list[str] = []
    linked: list[str] = []
    heading, at = False, 0

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            link_text = html.unescape(" ".join(linked))
            out.append(Block(text, len(text.split()), len(link_text.split()), heading, bool(still.articles), bool(still.asides)))
        parts.clear()
        linked.clear()

    def read(run: str) -> None:
        if run:
            parts.append(run)
            if still.at["a"]:
                linked.append(run)

    while True:
        start = page.find("<", at)
        if start < 0:
            read(page[at:])
            break
        read(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = _TAG.match(page, start)
        if not m:
            read("<")
            at = start + 1
            continue
        if not m[4]:
            break
        at, tag = m.end(), m[2].lower()
        if tag in SKIP:
            if not m[1] and not m[3].endswith("/"):
                end = _SKIPPED[tag].search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        if m[1]:
            if still.at[tag]:
                still.pop_to(still.at[tag][-1])
            heading = heading and tag not in HEADINGS
            continue
        if tag in VOID:
            continue
        if tag in ("article", "main", "body", "footer"):  # these end what was left open before them
            inside = still.first("article", "main") if tag == "footer" else None
            keep = min((i for i in (still.first(*filter(still.lacks_ends, ("p", "ul", "li", "head"))), still.loose[0] if still.loose else None, inside) if i is not None), default=None)
            if keep is not None and not (tag == "footer" and still.articles and still.articles[0] < keep):
                still.pop_to(keep)
        elif tag in BLOCK:
            heading = tag in HEADINGS
            i = still.last("p", tag) if tag in IMPLIED else still.last("p")
            if i > still.last(*BARRIERS):
                still.pop_to(i)
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        still.push(tag, *_marks(tag, m[3], bool(still.articles)))
    close()
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """For each block: words, link density, those of the block before and after, heading, in the article, aside."""
    edge = Block("", 0, 0, False, False, False)
    rows = []
    for b, c, d in zip([edge, *found], found, [*found[1:], edge]):
        rows.append((c.words, c.density, b.words, b.density, d.words, d.density, float(c.heading), float(c.article), float(c.aside)))
    return rows


def _table(text: str) -> list[tuple[tuple[float, ...], bool]]:
    rows = []
    for line in text.split("\n"):
        if line := line.strip():
            *values, label = line.split()
            rows.append((tuple(map(float, values)), label == "main"))
    return rows


#: Labelled blocks: words, link density, before, after (words and density each), heading, article, aside; label.
LABELLED = _table("""
    6 1.00  0 0.00   1 1.00  0 0 1 other
    1 1.00  6 1.00   1 1.00  0 0 1 other
    1 1.00  1 1.00  12 0.00  0 0 1 other
    12 0.00 1 1.00   9 0.00  0 0 1 other
    9 0.00  12 0.00 60 0.00  1 1 0 main
    60 0.00  9 0.00 85 0.00  0 1 0 main
    85 0.02 60 0.00 40 0.00  0 1 0 main
    40 0.00 85 0.02 11 0.00  0 1 0 main
    11 0.00 40 0.00  0 0.00  0 0 1 other
    3 0.00  11 0.00 70 0.00  0 1 0 main
    1 0.00   4 0.00 14 0.00  0 1 0 main
    2 0.00  90 0.00  8 0.00  0 1 0 main
    14 0.07  3 0.00 22 0.10  0 1 0 main
    7 0.00   2 1.00  6 0.00  1 1 0 main
    30 0.80  9 0.00 50 0.00  0 1 0 main
    5 1.00  50 0.00 45 0.00  0 1 0 main
    4 1.00   3 1.00  4 1.00  0 1 1 other
    25 0.00 80 0.00 30 0.00  0 1 1 other
    18 0.10 70 0.00 20 0.10  0 1 1 other
    150 0.00 8 0.00 90 0.00  0 1 1 other
    70 0.01  8 0.00 66 0.00  0 0 0 main
    66 0.00 70 0.01 35 0.05  0 0 0 main
    35 0.05 66 0.00  4 1.00  0 0 0 main
    20 0.00 60 0.00 55 0.00  0 0 0 main
    8 0.00  33 0.00 70 0.00  1 0 0 main
    9 0.00   3 1.00 58 0.00  1 0 0 main
    12 0.00 45 0.00 61 0.00  0 0 0 main
    16 0.00 24 0.00 30 0.00  0 0 0 main
    22 0.00  2 0.00  0 0.00  0 0 0 main
    40 0.00  0 0.00  0 0.00  0 0 0 main
    4 1.00   5 1.00  3 1.00  0 0 0 other
    3 1.00   4 1.00  6 0.00  0 0 0 other
    2 0.00   3 1.00  4 1.00  0 0 0 other
    6 0.50   4 1.00  3 0.67  0 0 0 other
    5 0.00   2 1.00  3 1.00  1 0 0 other
    30 0.90  4 1.00 28 0.95  0 0 0 other
    28 0.95 30 0.90  3 1.00  0 0 0 other
    45 0.60 12 0.80  9 1.00  0 0 0 other
    7 0.00   3 0.00  4 0.00  0 0 0 other
    4 0.00   7 0.00  2 0.50  0 0 0 other
    55 0.00 10 0.00 12 0.00  0 0 1 other
    90 0.05  6 0.00  5 1.00  0 0 1 other
    3 0.00  60 0.00  5 0.00  1 0 1 other
    62 0.00  1 1.00 48 0.00  0 0 1 other
    80 0.00 75 0.00 60 0.00  0 1 1 other
    35 0.00 50 0.02 44 0.00  0 0 1 other
    10 0.00 70 0.00 90 0.00  1 1 1 other
    28 0.04 66 0.00 10 0.00  0 0 1 other
    7 0.00  22 0.00 31 0.00  0 1 1 other
    15 0.00  1 1.00  7 0.00  0 0 1 other
    100 0.0 40 0.00 80 0.00  0 1 1 other
    44 0.00 12 0.00 12 0.00  0 0 1 other
    8 0.00   1 1.00 40 0.00  1 1 0 main
    10 0.00 11 0.00 24 0.00  1 1 0 main
    5 0.00   1 1.00  3 0.00  0 1 0 main
    9 0.00   9 0.00  9 0.00  0 1 0 main
    20 0.00 14 0.00 10 0.00  0 1 0 main
    6 0.20   8 0.00 12 0.00  0 1 0 main
    2 0.00   2 0.00  2 0.50  0 1 0 main
    3 1.00   4 0.00  5 1.00  0 1 0 main
    120 0.0  6 0.00  9 1.00  0 1 0 main
    33 0.00 15 0.00 11 0.00  0 1 0 main
    4 0.00   0 0.00  0 0.00  1 1 0 main
    1 0.00  18 0.00  6 1.00  0 1 0 main
    5 0.00   1 1.00  3 0.00  0 0 0 other
    6 0.20   8 0.00 12 0.00  0 0 0 other
    2 0.00   2 0.00  2 0.50  0 0 0 other
    3 1.00   4 0.00  5 1.00  0 0 0 other
    4 0.00   0 0.00  0 0.00  1 0 0 other
    1 0.00  18 0.00  6 1.00  0 0 0 other
    3 0.00   5 0.00  4 0.00  0 0 0 other
    5 0.00   6 0.00  8 0.00  0 0 0 other
    7 0.00   9 0.00  3 1.00  0 0 0 other
    2 0.00   9 0.00  6 0.00  0 0 0 other
    6 0.00   4 0.00  2 0.00  1 0 0 other
    4 0.00  12 0.00  9 0.00  0 0 0 other
    5 0.00  48 0.00 55 0.00  0 0 0 main
    3 0.00  60 0.00 42 0.02  0 0 0 main
    1 0.00  35 0.00 64 0.00  0 0 0 main
    6 0.00  22 0.00 80 0.00  1 0 0 main
    2 0.00  75 0.00 26 0.00  1 0 0 main
    7 0.00  41 0.05 38 0.00  0 0 0 main
    4 0.00   6 1.00 70 0.00  1 0 0 main
    4 0.00  30 0.00 21 0.00  0 0 0 main
    6 0.17  52 0.00 47 0.00  0 0 0 main
    7 0.00  15 0.00 90 0.00  1 0 0 main
    5 0.00   1 1.00 66 0.00  1 0 0 main
    3 0.00  50 0.00  7 0.00  0 0 0 main
    7 0.00  26 0.00  4 0.00  0 0 0 main
    4 0.00  33 0.00 30 0.85  0 0 0 other
    6 0.00  28 0.90 35 0.80  0 0 0 other
    5 0.00  40 0.75 50 0.00  0 0 0 other
    3 0.00  44 0.60  5 1.00  0 0 0 other
    2 1.00  40 0.00 36 0.00  0 0 0 other
    4 1.00  55 0.00 31 0.00  0 0 0 other
    5 1.00  24 0.00  3 1.00  0 0 0 other
    9 0.00   3 1.00  2 1.00  0 0 0 other
    11 0.00  4 1.00  5 1.00  0 0 0 other
    8 0.00   2 0.00  6 1.00  0 0 0 other
    9 0.00  40 0.00  6 0.00  0 0 0 main
    10 0.00  8 0.00 25 0.00  0 0 0 main
    5 1.00   0 0.00 60 0.00  0 0 0 other
    3 1.00   2 0.00 80 0.00  0 0 0 other
    8 0.90  12 0.00 70 0.00  0 0 0 other
    4 1.00  90 0.00  3 1.00  0 0 0 other
    6 1.00  70 0.00 40 0.00  0 0 0 other
    12 0.80 80 0.00 20 0.50  0 0 0 other
    6 1.00  64 0.00 75 0.00  0 0 0 other
    60 0.00 50 0.00  2 1.00  0 0 0 main
    100 0.0  3 1.00  4 1.00  0 0 0 main
    85 0.02 40 0.00  6 0.90  0 0 0 main
    50 0.00  1 1.00  2 1.00  0 0 0 main
    24 0.00 30 0.00  3 1.00  0 0 0 main
    20 0.00 60 0.00  0 0.00  0 0 1 other
    22 0.00  2 0.00  0 0.00  0 0 1 other
    40 0.00  0 0.00  0 0.00  0 0 1 other
    16 0.00 24 0.00 30 0.00  0 0 1 other
    70 0.01  8 0.00 66 0.00  0 0 1 other
    35 0.05 66 0.00  4 1.00  0 0 1 other
    6 0.00  22 0.00 80 0.00  1 0 1 other
    4 0.00  30 0.00 21 0.00  0 0 1 other
    9 0.00  40 0.00  6 0.00  0 0 1 other
    12 0.00 45 0.00 61 0.00  0 0 1 other
    8 0.00  33 0.00 70 0.00  1 0 1 other
    3 0.00  60 0.00 42 0.02  0 0 1 other
    15 0.00 55 0.00  0 0.00  0 1 1 other
    50 0.00 20 0.00 30 0.00  0 1 1 other
    9 0.00   3 1.00  2 1.00  0 1 0 main
    11 0.00  4 1.00  5 1.00  0 1 0 main
    8 0.00   2 0.00  6 1.00  0 1 0 main
    4 0.00  33 0.00 30 0.85  0 1 0 main
    6 0.00  28 0.90 35 0.80  0 1 0 main
    5 0.00  40 0.75 50 0.00  0 1 0 main
    3 0.00  44 0.60  5 1.00  0 1 0 main
    2 1.00  40 0.00 36 0.00  0 1 0 main
    4 1.00  55 0.00 31 0.00  0 1 0 main
    5 1.00  24 0.00  3 1.00  0 1 0 main
    30 0.90  4 1.00 28 0.95  0 1 0 main
    45 0.60 12 0.80  9 1.00  0 1 0 main
    12 0.00  4 0.00  2 0.00  0 1 0 main
    13 0.00  9 0.00  1 0.00  0 1 0 main
    6 0.50   4 1.00  3 0.67  0 1 0 main
    4 0.00   7 0.00  2 0.50  0 1 0 main
    7 0.00   3 0.00  4 0.00  0 1 0 main
    6 0.00   6 0.00  8 0.00  1 1 0 main
    1 0.00   2 0.00  3 0.00  1 1 0 main
    2 0.00   3 1.00  4 1.00  0 1 0 main
""")


def grow(rows: list[tuple[tuple[float, ...], bool]], least: int = 1):
    """A tree (feature, threshold, low, high) with labels as leaves; splits lower the Gini impurity the most, the first
    feature and threshold winning ties."""
    positive = sum(label for _, label in rows)
    if positive in (0, len(rows)):
        return positive > 0
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low = [label for x, label in rows if x[f] <= cut]
            high = [label for x, label in rows if x[f] > cut]
            if min(len(low), len(high)) < least:
                continue
            impurity = sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in (low, high))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return 2 * positive >= len(rows)
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], least), grow([r for r in rows if r[0][f] > cut], least)


@lru_cache(maxsize=1)
def tree():
    return grow(LABELLED)


def is_main(row: tuple[float, ...]) -> bool:
    node = tree()
    while not isinstance(node, bool):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_main(row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages`` (page_id, url, html): the main text, empty if there is none or the
    html is null.  A page of any length is read whole, in time in proportion to it.  Repeated rows are read each on their
    own; other columns are ignored."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return small_batches(pages).select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
