"""Main text of web pages: streaming parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's parser reports a page's tags and texts in one pass. A line is the text between two borders of blocks (pages often have no line
feeds), with its white space turned into single spaces; its ratio is the number of its characters outside links by the number of
tags since the line before. Menus, page headers, footers, asides, forms, notices, adverts, comments and hidden parts are known by tag, role, class and id
and have a ratio of 0; scripts, styles and other parts without prose give no line. Ratios are smoothed by a Gaussian, and lines
at or above their standard deviation are the content cluster.

Regions are elements. The cluster's characters are summed up the tree, and they choose the region: the article (or main element) that holds most of
them, if it has the page's title or at least a third; without one the innermost element that holds nearly all of them. Of an article all lines count
but those of the parts named above and of articles within it, which are comments by the standard; of another region those in the cluster, and those beside
one in the same container that are not mostly links.

Lines are joined by a line feed, in page order. A null or empty page, or one without text, has the empty text. Pages are independent: repeated rows,
null ids and urls, empty tables and extra columns need no care, and only the named columns are read. Pages of any length are read whole; work and memory are in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as c

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose borders end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that can be a region.
CONTAINERS = frozenset("article blockquote body center div main section td".split())
#: Elements without prose.
SILENT = frozenset("audio button canvas datalist iframe head math noframes noscript object option script select style svg template textarea title video".split())
#: Elements beside the main text, as far as they don't hold the title of an article.
BESIDE = frozenset("aside dialog footer form menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in classes and ids of parts beside the main text.
WORDS = frozenset(
    "ad ads adslot adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login menu menus modal nav navbar navi navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related "
    "replies respond share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead".split())
#: Names with one of these words tell of a part that is, or is not, somewhere else: `has-sidebar`.
ABOUT = frozenset("has with no without".split())
#: An element ends one of its own kind that is open within the list or table.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Lines on each side that the Gaussian reaches, and its deviation.
REACH, SIGMA = 2, 1.0
KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
KERNEL /= KERNEL.sum()


def named(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names of a class or id attribute has one of the words."""
    for name in names.split():
        own = [x.lower() for x in HUMP.split(name)]
        if not ABOUT.intersection(own) and words.intersection(own):
            return True
    return False


class Page(HTMLParser):
    """Lines of a page and the elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent = ["root"], [0]  # of each block; parents come before what they hold
        self.beside, self.titled = [False], [False]
        self.stack: list[tuple[str, int, bool]] = []  # open elements: name, block, whether its text is left out
        self.open: Counter[str] = Counter()
        self.silent = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, block, tags before its end, characters in links
        self.parts: list[str] = []
        self.block, self.at, self.tags, self.linked = 0, 0, 0, 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.at, self.tags, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def pop(self) -> str:
        tag, _, silent = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= silent
        if tag in BLOCKS:
            self.end_line()
            self.block = self.stack[-1][1] if self.stack else 0
        return tag

    def pop_to(self, *tags: str) -> None:
        while self.pop() not in tags:
            pass

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            elif tag in ("br", "wbr") and not self.silent:
                self.parts.append(" " if tag == "br" else "")
            return
        block = tag in BLOCKS
        if tag in ("html", "body", "head") and self.open[tag]:
            return
        if block and tag != "title" and self.open["head"] and tag != "html":
            self.pop_to("head")
        if block and self.open["p"]:
            self.pop_to("p")
        if tag in ENDS:
            for name, _, _ in reversed(self.stack):
                if name in WITHIN[tag]:
                    break
                if name in ENDS[tag]:
                    self.pop_to(name)
                    break
        found = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "style", "aria-hidden")} if attrs else {}
        beside = silent = tag in SILENT
        if not silent:
            beside = self.is_beside(tag, found)
            silent = beside and (not block or tag in ENDS or tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"))
        if block:
            self.end_line()
            self.tag.append(tag)
            self.parent.append(self.block)
            self.beside.append(beside)
            self.titled.append(False)
            self.block = len(self.tag) - 1
            if tag == "h1" and not silent and (self.open["article"] or self.open["main"]):
                self.mark()
        self.stack.append((tag, self.block, silent))
        self.open[tag] += 1
        self.silent += silent

    def is_beside(self, tag: str, found: dict[str, str]) -> bool:
        if tag in ("html", "body"):
            return False
        within = bool(self.open["article"] or self.open["main"])
        if tag in BESIDE or tag == "header" and not within:
            return True
        if not found:
            return False
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
            return True
        if found.get("role", "").lower() in ROLES and not (within and found["role"].lower() == "banner"):
            return True
        names = f"{found.get('class', '')} {found.get('id', '')}"
        return names != " " and tag != "main" and (named(names, WORDS) or not within and named(names, HEADER_WORDS))

    def mark(self) -> None:
        """The elements around the article, and itself, hold its title."""
        at = self.block
        while at and not self.titled[at]:
            self.titled[at] = True
            at = self.parent[at]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element of HTML, but for those that are always empty

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br" and not self.silent:
            self.parts.append(" ")
        if not self.open[tag]:
            return
        if tag not in BLOCKS and tag not in SILENT:
            for name, _, _ in reversed(self.stack):
                if name == tag:
                    break
                if name in BLOCKS:
                    return
        self.pop_to(tag)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if not self.parts or data and not data.isspace() and not any(x.strip() for x in self.parts):
            self.at = self.block
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a declaration that is none: left out up to its end
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Weighted means of each line's neighbours; beyond the page there is nothing."""
    return np.convolve(np.pad(ratios, REACH), KERNEL, "valid") if len(ratios) else ratios


def lines_of(html: str | None) -> list[str]:
    """The lines of the main text."""
    if not html:
        return []
    page = Page()
    page.feed(html)
    page.close()
    while page.stack:
        page.pop()
    page.end_line()
    lines = page.lines
    if not lines:
        return []
    n, tag, parent, titled = len(page.tag), page.tag, page.parent, page.titled
    own = [b and not t for b, t in zip(page.beside, titled, strict=True)]
    beside = own[:]
    for k in range(1, n):
        beside[k] = own[k] or beside[parent[k]]
    ratios = np.array([0.0 if beside[at] else max(0, len(text) - linked) / max(1, tags) for text, at, tags, linked in lines])
    smooth = smoothed(ratios)
    prose = np.array([2 * linked <= len(text) for text, _, _, linked in lines])  # not mostly links
    content = (smooth >= smooth.std()) & (ratios > 0) & prose
    mass, size = [0] * n, [0] * n  # characters in the cluster, and all outside the parts beside
    for (text, at, _, _), x in zip(lines, content.tolist(), strict=True):
        if not beside[at]:
            size[at] += len(text)
            mass[at] += len(text) if x else 0
    direct = mass[:]
    for k in range(n - 1, 0, -1):
        mass[parent[k]] += mass[k]
        size[parent[k]] += size[k]
    region = chosen(page, beside, mass, size)
    article = tag[region] in ("article", "main")
    inside, left_out, holder = [False] * n, [False] * n, list(range(n))
    inside[0] = region == 0
    for k in range(n):
        if k:
            inside[k] = k == region or inside[parent[k]]
            holder[k] = k if tag[k] in CONTAINERS or tag[k] in ("ul", "ol", "dl", "table") else holder[parent[k]]
        if inside[k] and k != region:
            left_out[k] = own[k] or left_out[parent[k]] or tag[k] == "article" and tag[region] == "article"
    near = [0] * n
    for k in range(n):
        near[holder[k]] += direct[k]
    out = []
    for (text, at, _, _), x, y in zip(lines, content.tolist(), prose.tolist(), strict=True):
        if inside[at] and not left_out[at] and (article or x or y and near[holder[at]]):
            out.append(text)
    return out


def chosen(page: Page, beside: list[bool], mass: list[int], size: list[int]) -> int:
    """The element that is the region of the main text."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    of_article = [False] * n  # within an article
    for k in range(1, n):
        of_article[k] = of_article[parent[k]] or tag[parent[k]] == "article"
    for kind in ("article", "main"):
        found = [k for k in range(n) if tag[k] == kind and not beside[k] and size[k] and not of_article[k]]
        best = max(found, key=lambda k: (mass[k], size[k], -k), default=0)
        if best and (page.titled[best] or 3 * mass[best] >= mass[0]):
            return best
    children: dict[int, list[int]] = {}
    for k in range(1, n):
        children.setdefault(parent[k], []).append(k)
    at = region = 0
    while True:  # down to where the cluster parts
        best = max(children.get(at, ()), key=lambda k: (mass[k], -k), default=0)
        if not best or not mass[best] or 5 * mass[best] < 4 * mass[0]:
            return region
        at = best
        region = at if tag[at] in CONTAINERS else region


def main_text(html: str | None) -> str:
    """The main text of one page: its lines joined by line feeds."""
    return "\n".join(lines_of(html))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page: its main text and the number of its code points."""
    c.tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.pieces_of(batches, "html", 1 << 20):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], ["id", "url", "text", "n_chars"])

    one = c.spread(pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")))
    kinds = [one.schema[x].dataType.simpleString() for x in ("id", "url")]
    return one.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(c.table(spark, sf_dir, "pages"))
