"""Main text of HTML pages from text-to-tag ratios.

The standard library's parser streams events. Text between block-level tags forms one
line, with the number of tags and the link text in it; what a browser never shows as text
(scripts, styles, templates) is not read. A line's ratio is its text outside links over
its tags. Names only lower ratios: lines in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, known by their elements or the words of their class,
id or role, have none, and where articles and main elements hold most of the text, lines
outside these count for a tenth. The ratios are smoothed with a Gaussian on a logarithmic
scale, and two clusters of lines are split by a threshold found by iteration, which is
never above what any paragraph reaches.

Dense lines select the content regions: an inner region replaces the one around it where
what it leaves outside is little and mostly sparse. First the outermost article and main
elements with at least half of their text in dense lines, else container by container
down from the root. A region is kept whole, so that headings, short paragraphs and lists
of links stay; where the region is the body, the lines from the first to the last dense
one, without runs of link-only lines. Lines without a ratio go unless they are dense.
A page without dense lines has no content.

Character references are decoded, white space in a block becomes one space (``<br>``
counts as white space), and blocks join with an empty line. A tag cut off by the end of
a page is dropped. Pages of any length are read whole. Containers that hold equally much
dense text are tried in page order. Null and empty pages, and pages without content,
give ''. Repeated rows give repeated results; an empty table gives an empty one; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import columns_ddl, slices, texts_of, tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is not shown as text of the page.
UNSEEN = frozenset("script style noscript template head title iframe object canvas svg".split())
#: Elements that mark their lines as boilerplate.
MARKED = frozenset("nav header footer aside form button select option textarea dialog menu".split())
#: Elements that can be the content region.
CONTAINERS = frozenset("body main article section div td".split())
#: Words of class, id and role that mark boilerplate.
HINTS = frozenset(
    """ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb
    breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies consent notice gdpr popup modal overlay
    newsletter subscribe subscription signup login form search comment comments disqus reply replies respond discussion social
    share sharing related recommended widget toolbar pagination pager copyright""".split()
)
#: Words that mark content; they outweigh hints other than those of comments and adverts.
CONTENT = frozenset("content article main post entry story".split())
STRONG = frozenset("ad ads advert advertisement comment comments reply replies cookie notice".split())
#: Closed by the next of their kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Gaussian smoothing of the line ratios.
SIGMA, RADIUS = 1.0, 2
#: Share of an article's text in dense lines, and of all text or dense text in articles, from which on they count.
DENSE_SHARE, ARTICLE_SHARE = 0.5, 0.5
#: What ratios outside of articles are lowered to where these hold most text.
OUTSIDE = 0.1
#: Most dense text that an inner container may leave outside.
LEFT_OUT = 0.1
#: Ratio of marked lines.
NO_RATIO = -1.0
#: Characters a tag, smoothed, from which on a line is dense whatever the other lines are.
SURELY_DENSE = 60.0

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_SPACE = re.compile(r"\s+")


def hinted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the words of class, id and role mark an element as boilerplate."""
    found = {w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v)}
    if tag in ("html", "body"):
        return False
    if found & CONTENT or tag in ("article", "main"):
        return bool(found & STRONG)
    return bool(found & HINTS)


class LineParser(HTMLParser):
    """Collects lines: (text, tags, link characters, container number, whether marked)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int]] = []  # tag, text not read, marked, container
        self.parents = [-1]  # container -> its parent
        self.kinds = [""]  # container -> its tag
        self.unread = self.marked = self.links = 0
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1][3] if self.stack else 0, self.marked > 0))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
                return
        else:
            self.flush()
            self.tags += 1
            self._close({"p"})
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag])
        if tag in VOID:
            return
        container = self.stack[-1][3] if self.stack else 0
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.parents) - 1
        marked = tag in MARKED or bool(attrs) and hinted(tag, attrs)
        # Marked inline elements are parts of a line, which they must not mark as a whole.
        unread = tag in UNSEEN or marked and tag in INLINE
        self.unread += unread
        self.marked += marked
        self.links += tag == "a"
        self.open[tag] += 1
        self.stack.append((tag, unread, marked, container))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self) -> None:
        tag, unread, marked, _ = self.stack.pop()
        self.unread -= unread
        self.marked -= marked
        self.links -= tag == "a"
        self.open[tag] -= 1

    def _close(self, tags: set[str]) -> None:
        """End the innermost open element of these tags, not looking beyond a container or list."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in CONTAINERS or tag in UNSEEN or tag in MARKED or tag in ("ul", "ol", "table", "dl"):
                return

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if not self.unread:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def dense(ratios: np.ndarray) -> np.ndarray:
    """Lines in the denser of two clusters of the smoothed ratios, on a logarithmic scale.

    Lines without text of their own are in it only where no line has any, marked ones never.
    """
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    padded = np.pad(np.log1p(np.maximum(ratios, 0)), RADIUS, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    threshold = smooth.mean()
    for _ in range(50):
        low, high = smooth[smooth < threshold], smooth[smooth >= threshold]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - threshold) < 1e-9:
            break
        threshold = new
    own = ratios > 0 if (ratios > 0).any() else ratios == 0
    return own & (smooth >= min(threshold, smooth[own].max(initial=0.0), np.log1p(SURELY_DENSE)))


def _selects(inside: np.ndarray, around: np.ndarray, found: np.ndarray, weight: np.ndarray, left_out: float) -> bool:
    """Whether the lines ``around`` but not ``inside`` hold little of the dense text and are mostly sparse."""
    rest = around & ~inside
    return weight[rest].sum() <= left_out * weight[around].sum() and (not rest.any() or 2 * found[rest].sum() < rest.sum())


def blocks(html: str) -> list[str]:
    """The blocks of the main text, in page order."""
    parser = LineParser()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return []
    text, tags, linked, at, marked = (np.array(x, dtype=d) for x, d in zip(zip(*lines, strict=True), (object, float, float, int, bool), strict=True))
    length = np.array([len(t) for t in text], dtype=float)
    size = np.maximum(0, length - linked)
    parents, kinds = parser.parents, parser.kinds
    top = np.zeros(len(parents), dtype=int)  # the outermost article or main that a container is in
    for c in range(1, len(top)):
        top[c] = top[parents[c]] or (c if kinds[c] in ("article", "main") else 0)
    ratios = size / np.maximum(1, tags)
    plain = np.where(marked, 0.0, size)
    if plain[top[at] > 0].sum() >= ARTICLE_SHARE * plain.sum():
        ratios[top[at] == 0] *= OUTSIDE
    ratios[marked] = NO_RATIO
    found = dense(ratios)
    if not found.any():
        return []
    kept = ~marked | found
    # A line of links alone has no size of its own, but counts where it is dense.
    weight = np.where(found, np.maximum(size, 1.0), 0.0)
    everywhere = np.ones(len(lines), dtype=bool)
    own, of_dense = (np.bincount(top[at], weights=w, minlength=len(top)) for w in (np.where(kept, np.maximum(size, 1.0), 0.0), weight))
    content = of_dense >= np.maximum(DENSE_SHARE * own, 1e-9)
    content[0] = False
    articles = content[top[at]]
    if articles.any() and _selects(articles, everywhere, found, weight, ARTICLE_SHARE):
        return list(text[articles & kept])
    held = np.bincount(at, weights=weight, minlength=len(top))
    for c in range(len(held) - 1, 0, -1):
        held[parents[c]] += held[c]
    heaviest = np.zeros(len(top), dtype=int)  # a container's child with most dense text
    for c in range(len(top) - 1, 0, -1):
        if heaviest[parents[c]] == 0 or held[c] >= held[heaviest[parents[c]]]:
            heaviest[parents[c]] = c
    last = np.arange(len(top))  # containers are numbered in page order, so what is in one follows it
    for c in range(len(top) - 1, 0, -1):
        last[parents[c]] = max(last[parents[c]], last[c])
    region, inside = 0, everywhere
    while heaviest[region]:
        child = heaviest[region]
        within = (at >= child) & (at <= last[child])
        # A container around all lines is gone through; it leaves nothing outside.
        if within.sum() < inside.sum() and not _selects(within, inside, found, weight, LEFT_OUT):
            break
        region, inside = child, within
    if kinds[region] not in ("", "body"):
        return list(text[inside & kept])
    only_links = (linked >= length) & (length > 0)
    run = np.array([only_links[max(0, i - 2) : i + 1].sum() == 3 for i in range(len(lines))])
    menu = np.array([run[i : i + 3].any() and only_links[i] for i in range(len(lines))])
    first, end = np.flatnonzero(found)[[0, -1]]
    between = (np.arange(len(lines)) >= first) & (np.arange(len(lines)) <= end)
    return list(text[between & inside & kept & ~menu])


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(html)) if html else ""


def extract(pages: DataFrame, *keep: Column, html: str = "html") -> DataFrame:
    """The ``keep`` columns with ``text`` and ``n_chars`` of every row."""
    source = pages.select(*keep, F.col(html).alias("_html"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            text = [main_text(h) for h in texts_of(batch, "_html").to_pylist()]
            out = [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.record_batch([*(batch.column(c) for c in names), *out], names=[*names, "text", "n_chars"])

    return source.mapInArrow(tidy(run), columns_ddl(source.schema.fields[:-1], "text string, n_chars long"))
