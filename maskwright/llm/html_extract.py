"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events. Text gathers into lines, one per
block element; each line has its ratio of characters to tags. The ratios are
smoothed with a Gaussian kernel and two clusters are told apart by a threshold,
the standard deviation of the smoothed ratios. A region is an article, main or
div element or the body; sections, cells, quotes and figures are part of the
region around them. An article with a line above the threshold is kept whole,
short lines too. Without articles, a region that has such a line of its own, or
several regions with such lines in it, is kept with all that stands in it; one
that merely holds such a region gives its own lines. The body gives its own
lines if one is above the threshold, or else its headings. Elements that are
boilerplate by tag, role, class or id never give lines.

A header or footer element, and what class, id or role marks as one, is never
text, also within an article; headings count wherever else they stand.

Defined results: null, empty and markup-only pages give an empty text; broken
markup is read on, character by character where the library gives up; repeated
rows are extracted each; pages of any length are read whole; without pages there
are no rows; input columns named text or n_blocks are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table, without

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br head title".split())
#: What ends the search for an open paragraph.
SCOPES = frozenset("article main section div body td center figure details blockquote".split())
CONTAINERS = frozenset("article main div body center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("head title nav header footer aside form script style noscript template menu button select option textarea iframe object svg canvas dialog search fieldset datalist audio video map applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Class and id words that mark what is not the article.
WORDS = frozenset(
    "ad ads adbox adblock adslot adsense advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion promotions promoted cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup paywall menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs sidebar sidebars aside rail "
    "related recommended recommendations trending share sharing social comment comments commentlist discussion disqus reply replies respond header masthead topbar footer colophon copyright login search "
    "searchbox searchbar toolbar pagination pager widget widgets skip hidden".split()
)
#: Words that say where or how something stands: with one of the words above they still mark what is not the article.
PLACES = frozenset(
    "site page global main primary secondary top bottom left right center inner outer upper lower first last sticky fixed floating mobile desktop container wrapper wrap box block bar area region section panel pane "
    "list item items link links button buttons icon icons form field input text title label body content group row column col cell unit slot frame zone holder wrapper thread reader readers user users post posts article articles "
    "story stories entry entries content message messages policy privacy legal media in out up to of and the google tag tags module component element inline native small large wide".split()
)
SPLIT = re.compile(r"[^a-z0-9]+")
#: Character references that the library can't turn into a number; like all beyond Unicode they are U+FFFD.
OVERLONG = re.compile(r"&#[0-9]{4000,};?")
#: Elements whose own class never makes them boilerplate: themes put flags for the whole page there.
ROOTS = frozenset(("html", "body", "main", "article"))


def marks(value: str) -> bool:
    """Whether one of the names of a class or id is a word above, or a compound of one with nothing but such words, places and numbers."""
    for name in value.split():
        parts = [p for p in SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if p]
        if not WORDS.isdisjoint(parts) and all(p in WORDS or p in PLACES or p[0].isdigit() for p in parts):
            return True
    return False


def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in BOILERPLATE:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return tag not in ("html", "body")
        if not value:
            continue
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True
        if name in ("class", "id") and tag not in ROOTS and marks(value):
            return True
    return False


class Lines(HTMLParser):
    """Streams a page into lines: (text, tags, region, outermost article or main element around it or 0, whether it is a heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.dropped = 0
        self.articles: list[int] = []
        self.regions = 0
        self.parents = [0]
        self.pages = {0}
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, int, bool]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            region = next((r for _, _, r in reversed(self.stack) if r), 0)
            self.lines.append((text, self.tags, region, self.articles[0] if self.articles else 0, bool(self.stack) and self.stack[-1][0] in HEADINGS))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag != "br" and self.stack and self.stack[-1][0] == "p":
                self.pop()
        self.tags += 1
        if tag in VOID:
            return
        drop = is_boilerplate(tag, attrs)
        if tag in BLOCKS or drop or self.dropped:  # within what is dropped each tag counts, so that its own end tag is told from theirs
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option") and self.stack and self.stack[-1][0] == tag:
                self.pop()
            if tag in CONTAINERS:
                self.regions += 1
                self.parents.append(next((r for _, _, r in reversed(self.stack) if r), 0))
                if tag == "body":
                    self.pages.add(self.regions)
            self.dropped += drop
            if tag in ("article", "main"):
                self.articles.append(self.regions)
            self.stack.append((tag, drop, self.regions if tag in CONTAINERS else 0))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # browsers ignore the slash
            self.handle_starttag(tag, attrs)

    def pop(self) -> None:
        tag, drop, _ = self.stack.pop()
        self.dropped -= drop
        if tag in ("article", "main"):
            self.articles.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if tag == "p" and self.stack[k][0] in SCOPES:
                return

    def parse_marked_section(self, i, report=1):
        """A declaration other than CDATA, or one without its end, is a comment up to the next ``>``, as in browsers."""
        end = super().parse_marked_section(i, report) if self.rawdata.startswith("<![CDATA[", i) else -1
        return end if end >= 0 else self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)

    def updatepos(self, i, j):
        self.seen = j
        return super().updatepos(i, j)

    def read(self, html: str) -> None:
        """The whole page: where the library gives up, that character is text and reading goes on behind it."""
        rest = OVERLONG.sub("\ufffd", html)
        while rest:
            self.rawdata, self.seen, fed = "", 0, 0
            try:
                self.feed(rest)
                fed, self.seen = len(rest) - len(self.rawdata), 0
                self.close()
                break
            except (AssertionError, ValueError):
                self.handle_data(rest[fed + self.seen])
                rest = rest[fed + self.seen + 1 :]
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's weights that lie within are used."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    around = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return around(ratios) / around(np.ones(len(ratios)))


def judged(parents: list[int], pages: set[int], mass: list[float], single: float) -> list[int]:
    """For each region 0: nothing stays, 1: its headings stay, 2: its own lines, 3: all that stands in it. Parents come before their children."""
    whole, largest = list(mass), [0.0] * len(mass)
    for r in range(len(mass) - 1, 0, -1):
        p = parents[r]
        whole[p] += whole[r]
        largest[p] = max(largest[p], whole[r])
    out = [0] * len(mass)
    for r in range(len(mass)):
        if r in pages:
            out[r] = 2 if mass[r] else 1
        elif out[parents[r]] == 3 or mass[r] or largest[r] < single * whole[r]:
            out[r] = 3
        elif whole[r]:
            out[r] = 2
    return out


def extract_blocks(html: str | None, sigma: float = 1.0, single: float = 0.9) -> list[str]:
    """The article's blocks in page order. ``single``: what share of a region's mass one region in it holds if the others are judged each for itself."""
    if not html:
        return []
    parser = Lines()
    parser.read(html)
    lines = parser.lines
    if not lines:
        return []
    if inside := any(x[3] for x in lines):
        lines = [x for x in lines if x[3]]
    ratios = np.array([len(x[0]) / max(1, x[1]) for x in lines])
    smooth = smoothed(ratios, sigma)
    mass = [0.0] * (parser.regions + 1)
    for x, above in zip(lines, np.minimum(smooth, ratios) >= smooth.std(), strict=True):  # smoothing alone would lift a menu beside the article
        mass[x[3] or x[2]] += len(x[0]) if above else 0
    if not any(mass):
        return [x[0] for x in lines]
    if inside:
        return [x[0] for x in lines if mass[x[3]]]
    stays = judged(parser.parents, parser.pages, mass, single)
    return [x[0] for x in lines if stays[x[2]] > 1 or x[4] and stays[x[2]]]


def extract_text(html: str | None, **options) -> str:
    return " ".join(extract_blocks(html, **options))


def extract_pages(pages: DataFrame, html_col: str = "html", **options) -> DataFrame:
    """``pages`` with text, the article's blocks joined by one space, and n_blocks; the html stays as it is."""
    pages = without(pages, "text", "n_blocks")
    at = pages.columns.index(html_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in chunks([len(x.as_py() or "") for x in batch.column(at)], 4 << 20):
                piece = batch.slice(a, z - a)
                blocks = [extract_blocks(h.as_py(), **options) for h in piece.column(at)]
                made = [pa.array([" ".join(b) for b in blocks], pa.string()), pa.array([len(b) for b in blocks], pa.int32())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], [*piece.schema.names, "text", "n_blocks"])

    return pages.mapInArrow(extract, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
