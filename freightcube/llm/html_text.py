"""Main text of web pages from parser events and text-to-tag ratios.

Method: the standard library's streaming parser gives events. Block boundaries cut them into lines; each line's
ratio is its text outside links, in characters, by its tags. Ratios are smoothed by a Gaussian along the page, and a threshold (their
standard deviation) divides the lines into content and the rest. The region with the content is selected: of the article
elements (else the main elements) the one with most content text; in a page without these, the smallest container with nine tenths
of it. All lines of the region are kept, short ones too, but for links that stand before or after all content where no article
bounds them.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments are told by element, role and
the words of class and id, and never count as content; headings in the header of an article stay. Character references are decoded, white
space inside a block is one space, blocks are trimmed and joined in page order by line feeds. Nothing else is dropped and no length is capped.

A page is parsed whole, by one call, in time linear in its length; a task holds a few copies of one page and one Arrow batch (bounded by ``small_batches``).

Edge cases: null, empty and text-free html give an empty text; markup cut off at the page's end is dropped, an unclosed comment to the end
of the page; elements that are never closed end with their container; plain text is content; repeated rows are pages of their own; null ids
and urls pass; an empty table gives an empty result. Other columns are carried in ``row`` and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, ship_by_value, small_batches, with_row

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CELLS = frozenset("td th caption".split())
ROWS = frozenset("table tbody tfoot thead tr".split())
REGIONS = frozenset("article body center div main section table td".split())
BLOCKS = REGIONS | HEADINGS | CELLS | ROWS | frozenset(
    "address aside blockquote dd details dialog dir dl dt fieldset figcaption figure footer form head header hr html legend li menu nav ol "
    "optgroup option p pre summary title ul".split())
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
#: Elements that never hold article text.
ASIDE = frozenset("aside button canvas dialog footer head iframe menu nav noscript object script select style svg template textarea title".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words of class names and ids of such elements.
ASIDE_WORDS = re.compile(
    r"ad(s|box|slot|sense|unit|block|banner|container|wrapper|space)?|advert\w*|sponsor\w*|promo(s|tion|tions|ted)?|banners?|"
    r"nav(s|bar|links?|menu|list|items?|igation)?|(sub|top|main)?menu(s|bar|items?)?|breadcrumbs?|sidebars?|aside|masthead|footer\w*|colophon|"
    r"cookies?\w*|consent|gdpr|notices?|popups?|modals?|newsletter\w*|subscribe\w*|subscription\w*|comment(s|list|form|box|area|section|thread)?|disqus|"
    r"respond|replies|share|sharing|social|related|widgets?|toolbar|pagination|pager|login")
#: Names that speak of the layout, not of the element.
LAYOUT = frozenset("has hide is no page show with without".split())
#: What an element's text is: in a form, in an article's header, or aside for good.
FORM, HEADER, GONE = 1, 2, 4
#: Lines on either side that a line's smoothed ratio depends on, and the Gaussian's deviation.
REACH, SPREAD = 2, 1.0
KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SPREAD) ** 2)
KERNEL /= KERNEL.sum()
#: Of the content text, what a container holds at least to be gone into.
SHARE = 0.9


def aside_by_name(names: str | None) -> tuple[bool, bool]:
    """Whether a class or id tells of boilerplate, and whether of a header."""
    gone = header = False
    for name in (names or "").split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if words and words[0] not in LAYOUT:
            gone |= any(ASIDE_WORDS.fullmatch(w) for w in words)
            header |= "header" in words
    return gone, header


class Lines(HTMLParser):
    """Lines of a page: text, characters outside links, tags, the region they stand in, whether a heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # element, kinds of its text, region
        self.open: Counter[str] = Counter()
        self.regions: list[tuple[str, int]] = [("", -1)]  # element, region around it
        self.kinds = self.region = self.links = self.articles = 0
        self.texts: list[str] = []
        self.rows: list[tuple[int, int, int, bool]] = []  # characters outside links, tags, region, links only
        self._start_line()
        self.tags = 0

    def _start_line(self) -> None:
        self.pieces: list[str] = []
        self.linked = self.skipped = 0

    def _end_line(self) -> None:
        if not self.pieces and not self.skipped:
            return
        text = " ".join("".join(self.pieces).split())
        if text or self.skipped:
            self.texts.append(text)
            self.rows.append((max(0, len(text) - self.linked), max(1, self.tags), self.region, bool(text) and self.linked >= len(text)))
            self.tags = 0
        self._start_line()

    def _kinds_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        kinds = self.kinds
        if tag in ("article", "main"):
            kinds &= ~FORM
        elif tag in HEADINGS:
            kinds &= ~HEADER
        elif tag == "form":
            kinds |= FORM
        elif tag in ASIDE:
            kinds |= GONE
        gone = header = False
        for name, value in attrs:
            if name in ("class", "id") and value and tag not in ("html", "body", "main"):
                found = aside_by_name(value)
                gone, header = gone or found[0], header or found[1]
            elif name == "role" and value and value.strip().lower() in ASIDE_ROLES:
                gone = True
        if gone and (tag != "article" or any("comment" in (v or "").lower() for n, v in attrs if n in ("class", "id"))):
            kinds |= GONE
        if tag == "header" or header and tag not in HEADINGS and tag != "article":
            kinds |= HEADER if self.articles else GONE
        return kinds

    def _pop(self) -> None:
        tag, self.kinds, self.region = self.stack.pop()
        self.open[tag] -= 1
        self.links -= tag == "a"
        self.articles -= tag == "article"

    def _close(self, tag: str, until: frozenset[str] = frozenset()) -> None:
        """Close the innermost open ``tag`` and all inside it, unless an element of ``until`` stands between."""
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == tag:
                while len(self.stack) > at:
                    self._pop()
                return
            if name in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._end_line()
        self.tags += 1
        if self.open["head"] and tag not in IN_HEAD:
            self._close("head")
        if block and self.open["p"]:
            self._close("p")
        if tag == "a" and self.open["a"]:
            self._close("a", BLOCKS)
        elif tag in ("li", "dd", "dt", "option") and self.open[tag]:
            self._close(tag, frozenset(("ul", "ol", "menu", "dl", "select")))
        elif tag == "tr" and self.open["tr"] or tag in CELLS and (self.open["td"] or self.open["th"]):
            for name in ("td", "th", *(["tr"] if tag == "tr" else [])):
                self._close(name, ROWS - {"tr"} if name == "tr" else ROWS)
        if tag in VOID:
            if tag == "br":
                self.pieces.append(" ")
            return
        kinds = self._kinds_of(tag, attrs)
        self.stack.append((tag, self.kinds, self.region))
        self.open[tag] += 1
        self.kinds = kinds
        self.links += tag == "a"
        self.articles += tag == "article"
        if tag in REGIONS:
            self.regions.append((tag, self.region))
            self.region = len(self.regions) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # outside svg, the slash means nothing
        if tag in ("path", "circle", "rect", "use", "g", "line", "polygon", "polyline", "ellipse"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self._end_line()
        elif tag == "br":
            self.pieces.append(" ")
        self.tags += 1
        if self.open[tag] > 0:
            table = tag in ROWS or tag in CELLS
            self._close(tag, frozenset() if table else ROWS | CELLS if block else BLOCKS)

    def handle_data(self, data: str) -> None:
        if self.kinds:
            self.skipped += len(data) if not data.isspace() else 0
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(" ".join(data.split()))

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def close(self) -> None:
        if re.match(r"<[a-zA-Z/!?]", self.rawdata):  # cut off inside a tag or comment
            self.rawdata = ""
        super().close()
        self._end_line()


def main_lines(page: Lines) -> tuple[np.ndarray, str]:
    """The numbers of the page's main lines, and how they were found: article, main, ratio or none."""
    has_text = np.array([bool(t) for t in page.texts], bool)
    if not has_text.any():
        return np.empty(0, np.int64), "none"
    chars, tags, region, only_links = (np.array(c) for c in zip(*page.rows))
    smooth = np.convolve(np.where(has_text, chars / tags, 0.0), KERNEL)[REACH:REACH + len(chars)]
    content = has_text & (smooth >= smooth.std()) & (chars > 0)
    if not content.any():
        content = has_text
    weight = np.bincount(region[content], chars[content] + 1.0, len(page.regions))
    texts = np.bincount(region[has_text], chars[has_text] + 1.0, len(page.regions))
    for i in range(len(page.regions) - 1, 0, -1):  # regions come after those around them
        weight[page.regions[i][1]] += weight[i]
        texts[page.regions[i][1]] += texts[i]
    for name in ("article", "main"):
        within = [False]
        for tag, around in page.regions[1:]:
            within.append(tag == name or within[around])
        found = [i for i, (tag, around) in enumerate(page.regions) if tag == name and texts[i] > 0 and not within[around]]  # outermost
        if found:
            chosen, how = max(found, key=lambda i: (weight[i], texts[i], -i)), name
            break
    else:
        chosen, how = 0, "ratio"
        children: dict[int, list[int]] = {}
        for i, (_, around) in enumerate(page.regions[1:], 1):
            children.setdefault(around, []).append(i)
        while True:
            most = max(children.get(chosen, []), key=lambda i: weight[i], default=None)
            if most is None or weight[most] < SHARE * weight[0]:
                break
            chosen = most
    member = [chosen == 0]
    for i, (_, around) in enumerate(page.regions[1:], 1):
        member.append(i == chosen or member[around])
    kept = has_text & np.array(member)[region]
    if how == "ratio":
        at = np.flatnonzero(content & kept)
        outside = np.ones(len(kept), bool)
        outside[at[0]:at[-1] + 1] = False
        kept &= ~(outside & only_links)
    return np.flatnonzero(kept), how


def main_text(html: str) -> tuple[str, int, str]:
    """(text, its number of blocks, how the region was found) of a page."""
    page = Lines()
    page.feed(html)
    page.close()
    kept, how = main_lines(page)
    return "\n".join(page.texts[i] for i in kept), len(kept), how


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h or "") for h in batch.column("html").to_pylist()]
        texts, blocks, how = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(blocks, pa.int32()), pa.array(how, pa.string())],
                                         ["row", "text", "n_blocks", "region"])


def extract_pages(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """row (the other columns), text, n_blocks and region (article, main, ratio, none) of every page."""
    small_batches(pages.sparkSession)
    others = [F.col(quoted(c)) for c in pages.columns if c != html_column]
    # A table of html alone still has a struct to carry.
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    sent = pages.select(row.alias("row"), F.col(quoted(html_column)).cast("string").alias("html"))
    schema: T.StructType = with_row(sent.schema["row"], "text string, n_blocks int, region string")
    return sent.mapInArrow(_extract, schema)


ship_by_value(__name__)
