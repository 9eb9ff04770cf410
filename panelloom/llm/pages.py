"""Main text of web pages: parser events, text-to-tag ratios, smoothing, thresholds, regions.

The standard library's parser turns a page into events; text between two block
boundaries is a line.  A line's ratio is its characters by its tags.  Ratios are
smoothed by a Gaussian, lines over the threshold are clusters, and the element
that holds most of the clusters' text is the content region.  What markup itself
calls boilerplate (menus, forms, adverts and the like) is no line at all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelloom.llm.store import bounded_batches, free_name

#: Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul title".split())
CELLS = frozenset(("td", "th", "br"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video".split())
ASIDE = frozenset("nav footer aside form button select textarea dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Words of class names and ids that name what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promoted promotion banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs topbar toolbar masthead footer foot colophon copyright sidebar sidebars aside widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts notification notifications popup modal overlay disclaimer "
    "newsletter subscribe subscription signup signin login register search searchform form share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion discussions pagination pager skiplink".split()
)
#: Each element closes an open one of the second list, up to the nearest of the third.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)

OPEN, MARKED, NAMED, HEAD, GONE = range(5)


def _kind(tag: str, given: list) -> int:
    """How an element is told from content: not at all, by its tag, by its names, as a header, or as unseen."""
    if tag in UNSEEN:
        return GONE
    if tag in ("html", "body"):
        return OPEN
    attrs = {k: v or "" for k, v in given}
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return GONE
    if tag in ASIDE or attrs.get("role", "").strip().lower() in ROLES:
        return MARKED
    header = tag == "header"
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in ("has", "with", "no", "is") and words[-1] not in ("enabled", "disabled", "open", "closed", "on", "off", "allowed"):
            if not HINTS.isdisjoint(words if tag not in ("article", "main") else words[:1]):
                return NAMED
            header |= "header" in words
    return HEAD if header else OPEN


class Lines(HTMLParser):
    """The lines of a page, and the tree of elements that they lie in.

    ``parent``, ``tags`` and ``kinds`` describe elements by number, the parent
    before the child; ``lines`` holds (element, text, tags, linked characters).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tags, self.kinds, self.roots = [0], ["#"], [OPEN], []
        self.stack, self.open = [0], Counter()
        self.lines: list[tuple[int, str, int, int]] = []
        self.pieces: list[str] = []
        self.seen = self.linked = self.anchors = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def read(self, html: str) -> Lines:
        self.feed(html)
        tail = self.rawdata
        if tail.startswith("<!--") or (tail[:1] == "<" and ">" not in tail and tail[1:2].isalpha()):  # a comment or tag without end
            self.rawdata = ""
        self.close()
        self._end_line()
        return self

    def _end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((self.stack[-1], text, self.seen, self.linked))
            self.seen = 0
        self.pieces, self.linked = [], 0

    def _pop(self) -> str:
        tag = self.tags[self.stack.pop()]
        self.open[tag] -= 1
        return tag

    def _close(self, wanted: tuple, bounds: tuple) -> None:
        """Close the nearest open element of ``wanted``, unless one of ``bounds`` is nearer."""
        if any(self.open[t] for t in wanted):
            for at in range(len(self.stack) - 1, 0, -1):
                tag = self.tags[self.stack[at]]
                if tag in wanted:
                    while len(self.stack) > at:
                        self._pop()
                    return
                if tag in bounds:
                    return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen += 1
        kind = _kind(tag, attrs)
        if tag in BLOCK or kind > OPEN:
            if tag in BLOCK:
                self._end_line()
                if self.open["p"]:
                    self._close(("p",), ("td", "th", "button", "object"))
                if tag == "body":
                    while len(self.stack) > 1:
                        self._pop()
            elif kind > OPEN and kind != GONE:
                self._end_line()
        if tag in CELLS:
            self.pieces.append(" ")
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag == "a":
            self.anchors = 1
        if tag in VOID:
            return
        if tag in BLOCK or tag in CELLS or kind > OPEN:
            self.parent.append(self.stack[-1])
            self.tags.append(tag)
            self.kinds.append(kind)
            self.stack.append(len(self.tags) - 1)
            self.open[tag] += 1
            given = dict(attrs)
            if kind == OPEN and (tag in ("article", "main") or given.get("role") == "main" or given.get("itemprop") == "articleBody"):
                self.roots.append(self.stack[-1])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash closes nothing in HTML, but on elements that do not hold text."""
        self.handle_starttag(tag, attrs)
        if tag in UNSEEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag == "a":
            self.anchors = 0
        if tag in BLOCK:
            self._end_line()
        elif tag in CELLS:
            self.pieces.append(" ")
        if self.open[tag]:
            barred = any(self.kinds[self.stack[-1]] == k for k in (MARKED, NAMED, HEAD))
            if barred:
                self._end_line()
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.kinds[self.stack[-1]] != GONE:
            self.pieces.append(data)
            if self.anchors:
                self.linked += len("".join(data.split()))


def _spread(ratios: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    """Gaussian smoothing; lines beyond the ends count as the nearest one."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), weights / weights.sum(), mode="valid")


def _inside(page: Lines, flagged: np.ndarray) -> np.ndarray:
    """For each element whether it or one that holds it is flagged."""
    out = flagged.copy()
    for i, p in enumerate(page.parent):
        out[i] |= out[p]
    return out


def _barred(page: Lines, lifted: bool) -> np.ndarray:
    """Elements outside the article by markup.

    Headings in the header of an article stay.  If every article lies in an
    element that markup bars, or if nothing else is left, only what is unseen
    is barred around it.
    """
    kinds = np.array(page.kinds)
    rooted = np.zeros(len(kinds), bool)
    rooted[page.roots] = True
    rooted = _inside(page, rooted)
    flagged = kinds > OPEN
    if lifted:
        flagged &= (kinds == GONE) | (kinds == MARKED)
    head = _inside(page, kinds == HEAD)
    titles = np.array([t in HEADINGS for t in page.tags]) & rooted & head & (kinds == OPEN)
    out = _inside(page, flagged)
    if titles.any():
        out[titles] = _inside(page, flagged & (kinds != HEAD))[titles]
    if page.roots and out[page.roots].all():
        for i in page.roots:
            while i:
                if kinds[i] != GONE:
                    flagged[i] = False
                i = page.parent[i]
        out = _inside(page, flagged)
    return out


def _sums(page: Lines, own: np.ndarray) -> np.ndarray:
    """Of each element, what it and all within it hold."""
    out = own.copy()
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] += out[i]
    return out


def _under(page: Lines, root: int) -> np.ndarray:
    flagged = np.zeros(len(page.parent), bool)
    flagged[root] = True
    return _inside(page, flagged)


def _menus(lines: list, least: int = 3) -> np.ndarray:
    """Lines in runs of at least ``least`` that are all links."""
    linked = np.array([n >= 0.9 * len(t.replace(" ", "")) for _, t, _, n in lines])
    out, start = np.zeros(len(lines), bool), 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not linked[i]:
            if i - start >= least:
                out[start:i] = True
            start = i + 1
    return out


def main_text(html: str | None, radius: int = 2, sigma: float = 1.0, share: float = 1.0) -> str:
    """The article of one page, a line per block; empty if there is none.

    ``share`` is the threshold in standard deviations of the smoothed ratios.
    An ``article`` or ``main`` element is the region if there is one (the one
    with most clustered text); else it is the element that holds most of it,
    widened while the next one around it adds over a quarter.
    """
    page = Lines().read(html or "")
    free: list = []
    for lifted in (False, True):
        barred = _barred(page, lifted)
        free = [line for line in page.lines if not barred[line[0]]]
        if free:
            break
    if not free:
        return ""
    at = np.array([e for e, *_ in free])
    chars = np.array([len(t) for _, t, _, _ in free], float)
    unlinked = np.array([max(0, len(t) - n) for _, t, _, n in free], float)
    smooth = _spread(unlinked / np.maximum(1, [n for _, _, n, _ in free]), radius, sigma)
    content = (smooth >= min(share * smooth.std(), smooth.max())) & ~_menus(free)
    if not content.any():
        content = ~_menus(free)
    own = np.zeros(len(page.parent))
    np.add.at(own, at[content], chars[content])
    held = _sums(page, own)
    roots = [r for r in page.roots if not barred[r] and held[r] > 0]
    if roots:
        region = max(roots, key=lambda r: (held[r], -r))
        kept = _under(page, region)[at] & ~_menus(free)
    else:
        groups = own.copy()
        for i, tag in enumerate(page.tags):  # a paragraph's text counts for what holds the paragraph
            if tag in ("p", "pre", "li", "dt", "dd", "blockquote", "tr", "td", "th") or tag in HEADINGS:
                groups[page.parent[i]] += groups[i]
        region = int(np.argmax(groups))
        while region and page.tags[region] in HEADINGS | {"p", "pre"}:
            region = page.parent[region]
        widest = region
        while widest:
            widest = page.parent[widest]
            if held[widest] > 1.25 * held[region]:
                region = widest
        inside = _under(page, region)[at]
        if region == 0 or page.tags[region] in ("body", "html"):
            near = np.array([page.parent[e] == region or e == region for e in at])
            inside &= content | near
        kept = inside & ~_menus(free)
    return "\n".join(t for (_, t, _, _), k in zip(free, kept, strict=True) if k)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but the html, with the main text and its code points.

    Added: ``text`` and ``n_chars``; a column of ``pages`` with one of these
    names stays, and the new one gets an underscore more.  Null, empty and
    broken pages give an empty text at worst.  Repeated rows stay, an empty
    table gives an empty one.  A page of any length is read whole by one worker.
    """
    bounded_batches(pages.sparkSession)
    at = pages.columns.index(html_col)
    rest = pages.drop(html_col)
    schema = T.StructType(list(rest.schema)).add(free_name(rest, "text"), "string").add(free_name(rest, "n_chars"), "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html) for html in batch.column(at).to_pylist()]
            others = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names)

    return pages.mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page; handles rows as :func:`extract`."""
    return extract(pages.select("page_id", "url", "html"))
