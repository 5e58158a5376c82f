"""Main text of HTML pages: text-to-tag ratios of lines from streamed parser events.

The standard library's parser streams each page's events.  Block-level tags end a
line; a line has its text, its number of tags, and the region it lies in (the
outermost article or main element, else the nearest sectioning block).  Scripts,
menus, controls, and elements named as adverts or comments are left out.  The lines'
text-to-tag ratios are smoothed with a Gaussian and clustered by a threshold, their
standard deviation; a region is content if a line of it reaches the threshold, and
articles that do go before all else.  On pages without such an article ratios are
smoothed within each region only, and the content is the lowest element around all
lines that reach the threshold, without the lists and sections in it that hold no such
line and mostly links; lines at the page's end that name a copyright aren't looked at.
All other text of the content is returned, short lines too.

Names of layout parts only vote inside an article: such a part goes if its text is
mostly links or its ratios stay below the threshold.  Where a word of a name says
advert, comment or notice (``advert-box``, ``user-comments``), the part goes if a line
outside it reaches the threshold, so a wrapper of the whole article stays; a notice
with a heading is a section of the article.  A form's text goes unless the form is
around an article, or holds most of a page without one.  Other classes and ids count as
whole words; an article or main inside an element dropped by its name is looked at
again if the page has no other.

Defined results: a null or empty page, or one without text, has empty text;
unclosed, omitted and stray tags are allowed anywhere (a head ends where the body's
elements or text begin); white space is what Unicode calls so; repeated rows give
equal results; an empty table gives an empty one; other columns are carried through,
but the result replaces a column of its name; pages are handled one at a time and
whole, in time that grows with their length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import arrays

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements whose tags break the text into blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)

#: Elements that never hold the article's text.
DROPPED = frozenset(
    "head script style noscript template nav aside button select textarea label legend datalist svg math iframe object canvas audio video dialog menu".split()
)

#: Elements that a head may hold; any other one ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

#: Elements that end an open one of the second set, up to one of the third.
IMPLIED = {
    **dict.fromkeys(("li",), (frozenset(("li",)), frozenset(("ul", "ol", "menu")))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    **dict.fromkeys(("tr",), (frozenset(("tr",)), frozenset(("table",)))),
}

#: Dropped too unless they are inside the article.
PAGE_PARTS = frozenset("header footer".split())

#: Elements that hold sections of a page.
SECTIONS = frozenset("article main section div td body html center".split())

#: Roles, and whole classes or ids, that mark what is no content: texts beside the article's, and parts of the layout.
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OTHER_TEXTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion recommended comment comments disqus replies "
    "ad-banner ad-container ad-slot ad-unit ad-wrapper google-ad banner-ad related-posts related-articles related-stories related-content recommended-posts "
    "comment-list comments-area comments-section comment-section comment-form disqus_thread cookie-notice cookie-banner cookie-consent cookie-bar".split()
)
LAYOUT = frozenset(
    "related discussion reply banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar rail widget header masthead footer cookie cookies consent gdpr notice alert popup "
    "modal newsletter subscribe signup login search share sharing social pagination pager toolbar skip-link site-header site-footer page-footer main-footer "
    "footer-links footer-nav footer-menu footer-widgets site-nav site-navigation main-nav main-navigation main-menu nav-menu nav-links nav-bar top-nav top-bar "
    "left-sidebar right-sidebar sidebar-left sidebar-right widget-area share-buttons share-links social-links social-share social-media search-form search-box "
    "login-form newsletter-signup newsletter-form gdpr-notice".split()
)

#: Words of a name, between hyphens and underscores, that say that its element holds another text, or a notice.
OTHER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus replies".split())
NOTICE_WORDS = frozenset("notice notices cookie cookies consent gdpr disclaimer".split())

#: Elements that may be a list of links between blocks of text.
LISTS = SECTIONS | frozenset("dl ol table tbody tr ul".split())

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_WORDS = re.compile(r"[-_\s]+")
_COPYRIGHT = re.compile(r"(?i)\s*(copyright\b|\(c\)\s)|.*©")

#: Levels of dropping; an article or main inside the second or third is looked at again.
_NOT, _LAYOUT, _OTHER, _WHOLLY = range(4)
_NONE = -1  # of a region that is no article


class _Line(NamedTuple):
    text: str
    tags: int
    region: int
    container: int
    doubt: int  # the part of an article with a layout name that it lies in, or 0
    form: int  # the outermost form inside the article, or on the page, or 0
    linked: int  # characters inside links
    anchors: int  # links that begin in it
    named: int  # the innermost part named as another text or a notice that it lies in, or 0


class _Open(NamedTuple):
    """An open element, and what held before it."""

    tag: str
    level: int
    region: int
    container: int
    articles: int
    doubt: int
    form: int
    named: int


class _Lines(HTMLParser):
    """Collects the lines outside dropped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[_Open] = []
        self.scopes: list[dict[str, int]] = [{}]  # open inline elements by name, since each open block
        self.blocks: dict[str, int] = {}  # open blocks by name
        self.level = 0  # of dropping
        self.articles = 0  # open article and main elements
        self.kinds: dict[int, int] = {}  # of a region that is an article: the level it was found in
        self.parents, self.names = [0], ["html"]  # of the containers, all block elements
        self.text: list[str] = []
        self.around, self.notices, self.headed = [0], {0}, set()  # of the parts named so: the part around, which are notices, which have a heading
        self.tags = self.region = self.regions = self.container = self.doubt = self.form = self.linked = self.anchors = self.named = 0

    def end_line(self) -> None:
        if not self.text:
            return
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(_Line(text, self.tags, self.region, self.container, self.doubt, self.form, self.linked, self.anchors, self.named))
            self.tags = self.linked = self.anchors = 0
        self.text.clear()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't used

    # The page is fed at once: what has no end runs to the page's end and isn't searched again.

    def _after(self, mark: str, i: int) -> int:
        k = self.rawdata.find(mark, i)
        return len(self.rawdata) if k < 0 else k + len(mark)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._after("-->", i + 4)

    def parse_html_declaration(self, i: int) -> int:
        return self._after(">", i)

    def parse_pi(self, i: int) -> int:
        return self._after(">", i)

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def _drops(self, tag: str, attrs: list) -> int:
        if tag in DROPPED or tag in PAGE_PARTS and not self.articles:
            return _WHOLLY
        if not attrs or tag in ("html", "body", "article", "main"):
            return _NOT
        known = dict(attrs)
        if "hidden" in known or (known.get("role") or "").lower() in DROPPED_ROLES:
            return _WHOLLY
        if tag in _HEADINGS or tag in PAGE_PARTS:
            return _NOT
        text = f"{known.get('class') or ''} {known.get('id') or ''}".lower()
        names = text.split()
        drops = _OTHER if not OTHER_TEXTS.isdisjoint(names) else _LAYOUT if not LAYOUT.isdisjoint(names) else _NOT
        if drops != _OTHER and tag in BLOCK:
            words = _WORDS.split(text)
            other = not OTHER_WORDS.isdisjoint(words)
            if other or not NOTICE_WORDS.isdisjoint(words):
                self.around.append(self.named)
                self.named = len(self.around) - 1
                if not other:
                    self.notices.add(self.named)
        return drops

    def _close_last(self) -> str:
        last = self.open.pop()
        if last.tag in BLOCK or last.tag == "head":
            self.scopes.pop()
            self.blocks[last.tag] -= 1
        else:
            self.scopes[-1][last.tag] -= 1
        _, self.level, self.region, self.container, self.articles, self.doubt, self.form, self.named = last
        return last.tag

    def _close(self, tag: str) -> None:
        """Close the innermost open element of this name, which there must be, and all inside it."""
        while self._close_last() != tag:
            pass

    def _implied_ends(self, tag: str) -> None:
        if self.blocks.get("head") and tag not in IN_HEAD:
            self._close("head")
        if tag in BLOCK and self.blocks.get("p"):
            self._close("p")  # a paragraph holds no block
        if tag in IMPLIED:
            ended, outside = IMPLIED[tag]
            if any(self.blocks.get(x) for x in ended):
                k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag in BLOCK and (self.open[k].tag in ended or self.open[k].tag in outside)), -1)
                if k >= 0 and self.open[k].tag in ended:
                    while len(self.open) > k:
                        self._close_last()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK and not self.level:
            self.end_line()
        self._implied_ends(tag)
        if tag == "br" and not self.level:
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        article = tag in ("article", "main")
        opened = _Open(tag, self.level, self.region, self.container, self.articles, self.doubt, self.form, self.named)
        drops = self._drops(tag, attrs)
        self.open.append(opened)
        if tag == "a":
            self.anchors += 1
        elif tag in _HEADINGS and tag != "p":
            self.headed.add(self.named)
        if tag in BLOCK or tag == "head":
            self.scopes.append({})
            self.blocks[tag] = self.blocks.get(tag, 0) + 1
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        if drops == _LAYOUT and self.articles:
            drops, self.doubt = _NOT, self.doubt or len(self.names)
        if tag == "form":
            self.form = self.form or len(self.names)
        found = self.level = max(self.level, drops)
        if article and not self.articles:
            self.form = self.named = 0
            if _NOT < found < _WHOLLY:
                self.end_line()
                self.level = _NOT
        if tag in BLOCK:
            self.parents.append(self.container)
            self.names.append(tag)
            self.container = len(self.names) - 1
        if tag in SECTIONS and not self.articles:
            self.regions += 1
            self.region = self.regions
            if article:
                self.kinds[self.region] = found
        self.articles += article

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't close an HTML element

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK and not self.level:
            self.end_line()
        # else a stray end tag; that of an inline element doesn't reach beyond its block
        if self.blocks.get(tag) if tag in BLOCK or tag == "head" else self.scopes[-1].get(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.blocks.get("head") and self.open[-1].tag == "head" and not data.isspace():
            self._close("head")
        if not self.level:
            self.text.append(data)
            if self.scopes[-1].get("a"):
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian of three deviations to either side; ends see their own weight only."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    spread = np.convolve(ratios, weights)[reach : reach + len(ratios)]
    return spread / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def _by_region(lines: list[_Line], ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Ratios smoothed along the lines of each region, which see no other region's."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        places.setdefault(x.region, []).append(i)
    out = ratios.copy()
    for at in places.values():
        if len(at) > 1:
            out[at] = smoothed(ratios[at], sigma)
    return out


def _reaching(lines: list[_Line], smooth) -> list[_Line]:
    """The lines whose smoothed ratio of text to tags reaches the deviation of all."""
    ratios = smooth(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    threshold = float(ratios.std())
    return [x for x, r in zip(lines, ratios.tolist(), strict=True) if r >= threshold]


def _without_named(parser: _Lines, lines: list[_Line], over: list[_Line]) -> list[_Line]:
    """Without parts named as other texts or notices, if there is text over the threshold outside them."""
    size = len(parser.around)
    if size == 1:
        return lines
    inside, headed = [0] * size, [k in parser.headed for k in range(size)]
    for x in over:
        inside[x.named] += 1
    for k in range(size - 1, 0, -1):  # parts come after those around them
        inside[parser.around[k]] += inside[k]
        headed[parser.around[k]] = headed[parser.around[k]] or headed[k]
    gone, left = [False] * size, len(over)
    for k in range(1, size):
        gone[k] = gone[parser.around[k]]
        if not gone[k] and left > inside[k] and not (k in parser.notices and headed[k]):
            gone[k], left = True, left - inside[k]
    return [x for x in lines if not gone[x.named]]


def _inside_common(parser: _Lines, lines: list[_Line], over: list[_Line]) -> list[str]:
    """Texts of the lines inside the lowest container of all lines of ``over``, without lists of links beside them."""
    parents, names = parser.parents, parser.names
    outer = set(parents[1:])
    # a block of text is no container of its siblings; a table's cell may hold a whole page
    ends = {c if c in outer or names[c] in ("td", "th", "body", "html") else parents[c] for c in (x.container for x in over)}
    heap = [-c for c in ends]
    heapq.heapify(heap)
    while len(heap) > 1:
        last = -heapq.heappop(heap)  # parents come before their children
        ends.remove(last)
        if parents[last] not in ends:
            ends.add(parents[last])
            heapq.heappush(heap, -parents[last])
    common = -heap[0]
    content, size, linked, anchors = ([0] * len(parents) for _ in range(4))
    for x in lines:
        size[x.container] += len(x.text)
        linked[x.container] += x.linked
        anchors[x.container] += x.anchors
    for x in over:
        content[x.container] += 1
    for c in range(len(parents) - 1, 0, -1):
        for counts in (content, size, linked, anchors):
            counts[parents[c]] += counts[c]
    inside = [common == 0] * len(parents)
    for c in range(1, len(parents)):
        links = names[c] in LISTS and not content[c] and anchors[c] > 1 and 2 * linked[c] > size[c]
        inside[c] = c == common or inside[parents[c]] and not links
    return [x.text for x in lines if inside[x.container]]


def _without_forms(lines: list[_Line], whole: bool) -> list[_Line]:
    """Without the text of forms; with ``whole`` a form that holds half of all text is the page, and stays."""
    sizes: dict[int, int] = {}
    for x in lines:
        sizes[x.form] = sizes.get(x.form, 0) + len(x.text)
    half = sum(sizes.values()) / 2
    return [x for x in lines if not x.form or whole and sizes[x.form] >= half]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The blocks of the content regions, joined by an empty line."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    if not parser.level:
        parser.end_line()
    kinds = parser.kinds
    found = {kinds.get(x.region, _NONE) for x in parser.lines}
    best = next((k for k in (_NOT, _LAYOUT, _NONE, _OTHER) if k in found), _NONE)
    lines = _without_forms([x for x in parser.lines if kinds.get(x.region, _NONE) in (best, _NONE)], best == _NONE)
    if not lines:
        return ""
    over = _reaching(lines, lambda raw: smoothed(raw, sigma))
    articles = {x.region for x in over if x.region in kinds}
    if not articles:
        end = len(lines)
        while end and _COPYRIGHT.match(lines[end - 1].text):
            end -= 1
        lines = lines[:end] or lines
        over = _reaching(lines, lambda raw: _by_region(lines, raw, sigma))
        left = _without_named(parser, lines, over)
        places = set(map(id, left))
        return "\n\n".join(_inside_common(parser, left, [x for x in over if id(x) in places]))
    lines = _without_named(parser, [x for x in lines if x.region in articles], [x for x in over if x.region in articles])
    # parts with a layout name stay where the ratios and the links say that they are text
    text = {x.doubt for x in over if x.doubt}
    for part in list(text):
        own = [x for x in lines if x.doubt == part]
        if 2 * sum(x.linked for x in own) > sum(len(x.text) for x in own):
            text.remove(part)
    return "\n\n".join(x.text for x in lines if x.region in articles and (not x.doubt or x.doubt in text))


def extract(pages: DataFrame, html: str = "html", to: str = "text", sigma: float = 1.0) -> DataFrame:
    """``pages`` with the main text of each."""
    keep = [c for c in pages.columns if c != to]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), sigma) for x in batch.column(keep.index(html))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*keep, to])

    return arrays.batched(pages.select(*keep)).mapInArrow(run, schema)
