"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with the path of tags from the root to it. Per path,
text length and punctuation are added up over its blocks; the ratios of text and punctuation to
blocks are smoothed over the page's order, multiplied, and compared with the spread of all.
Blocks on paths above the threshold are content nodes. The text's place is the deepest container
that holds all of them, and no deeper than an article; every block inside goes out, except
furniture: elements that are menus, notices, forms and so on by their tag or role, or by their
name where they do not hold most of the content, and lists of links on paths below the threshold.
Reader comments and consent notices go however long they are, unless an article or a first
heading is inside: the former by their name and repeated items, the latter by their name.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from layerlens.llm.common import fresh, map_arrow, with_field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset(
    "head script style noscript template iframe object svg canvas title nav footer aside form "
    "button select textarea option dialog menu audio video map".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var br wbr img".split()
)
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
ENDS_PARAGRAPH = frozenset(
    "p div ul ol dl li table section article main aside header footer nav form h1 h2 h3 h4 h5 h6 "
    "pre blockquote hr address figure fieldset details".split()
)
#: An opening tag that closes an open one of these kinds, if nothing of the last set is between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar "
    "menu nav navbar navigation navi breadcrumb breadcrumbs header footer masthead cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share "
    "sharing social related recommended comment comments commentlist disqus replies respond form "
    "search toolbar pagination pager widget copyright legal disclaimer".split()
)
#: Names that are part of the article where they come with one of OWN, as in "entry-header".
TITLES = frozenset("header masthead notice legal form search copyright banner".split())
OWN = frozenset("article post entry content story main".split())
#: Names of reader comments and of consent notices, which may be longer than the article.
READERS = frozenset("comment comments commentlist disqus replies".split())
CONSENT = frozenset("cookie cookies consent gdpr".split())
#: Alike children that make a list of comments.
REPEATED = 3
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
WORDS = re.compile(r"[a-z]+")


class _Page(HTMLParser):
    """Collects blocks; elements are numbered, with their parent, so that depth costs nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.path = [-1], ["#"], [0]
        self.named: list[int] = []  # elements whose name is one of furniture
        self.readers: list[int] = []  # those of comments, and of consent
        self.consent: list[int] = []
        self.look: list[tuple[str, str]] = [("#", "")]  # tag and class, which repeated items share
        self.open = Counter()  # elements of each tag on the stack
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.hidden = 0  # how deep the stack was when furniture began, or 0
        self.article = 0
        self.blocks: list[tuple[int, int, str, int]] = []  # element, path, text, link characters
        self.pieces: list[str] = []
        self.linked = 0
        self.links = 0

    def _flush(self):
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                at = len(self.stack) - 1
                while at and self.tag[self.stack[at]] in INLINE:
                    at -= 1
                element = self.stack[at]
                self.blocks.append((element, self.path[element], text, self.linked))
            self.pieces = []
        self.linked = 0

    def _furniture(self, tag, attrs) -> bool:
        if tag in UNSEEN or (tag == "header" and not self.article):
            return True
        for name, value in attrs:
            if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
            if name == "role" and value and value.lower() in ROLES:
                return True
        return False

    def _name(self, tag, attrs) -> None:
        """A vote only: `main_text` decides on it by what the element holds."""
        if tag in HEADINGS or tag in ("html", "body", "article", "main"):
            return
        element, named = len(self.tag) - 1, False
        for name, value in attrs:
            if name in ("class", "id") and value:
                words = set(WORDS.findall(value.lower()))
                named = named or bool(FURNITURE & words - (TITLES if words & OWN else frozenset()))
                if not words & OWN:
                    if READERS & words:
                        self.readers.append(element)
                    if CONSENT & words:
                        self.consent.append(element)
        if named:
            self.named.append(element)

    def _close_to(self, depth: int):
        """Closes the elements above `depth`."""
        while len(self.stack) > depth:
            tag = self.tag[self.stack.pop()]
            self.open[tag] -= 1
            self.article -= tag in ("article", "main")
            self.links -= tag == "a"
        if self.hidden and len(self.stack) <= self.hidden:
            self.hidden = 0

    def _find(self, tags, stop) -> int:
        if not any(self.open[tag] for tag in tags):
            return 0  # without a walk, however deep the page is
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                return depth
            if tag in stop:
                return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "wbr":
            if tag == "br" and not self.hidden:
                self.pieces.append(" ")
            return
        if tag not in INLINE:
            self._flush()
        if tag == "body":  # whatever of the head is still open ends here
            depth = self._find({"head"}, ())
            if depth:
                self._close_to(depth)
        if tag in ENDS_PARAGRAPH:
            depth = self._find({"p"}, {"td", "th", "li", "div", "section", "article", "aside", "button", "table"})
            if depth:
                self._close_to(depth)
        if tag in SIBLINGS:
            depth = self._find(*SIBLINGS[tag])
            if depth:
                self._close_to(depth)
        if tag in VOID:
            return
        above = self.stack[-1]
        self.parent.append(above)
        self.tag.append(tag)
        key = (self.path[above], tag)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        if not self.hidden and self._furniture(tag, attrs):
            self.hidden = len(self.stack)
        self.look.append((tag, next((v or "" for n, v in attrs if n == "class"), "")))
        if not self.hidden:
            self._name(tag, attrs)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1
        self.article += tag in ("article", "main")
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag(tag, [])
            return
        if tag not in INLINE:
            self._flush()
        depth = self._find({tag}, {"table", "td", "th"} if tag in INLINE or tag == "p" else ())
        if depth:
            if tag not in INLINE or all(self.tag[e] in INLINE for e in self.stack[depth:]):
                self._close_to(depth)

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data)


def scores(paths: list[int], texts: list[str], smooth: int = 1) -> np.ndarray:
    """Per block, the smoothed and fused text and punctuation ratio of its path."""
    _, path = np.unique(paths, return_inverse=True)
    blocks = np.bincount(path)
    length = np.bincount(path, [len(t) for t in texts]) / blocks
    marks = np.bincount(path, [len(PUNCTUATION.findall(t)) + 1 for t in texts]) / blocks
    weights = np.exp(-0.5 * np.arange(-smooth, smooth + 1) ** 2)

    def smoothed(values):
        total = np.convolve(np.pad(values, smooth, mode="edge"), weights / weights.sum(), "valid")
        return total

    return smoothed(length[path]) * smoothed(marks[path])


def _chosen_under(page: _Page, elements, texts, chosen) -> np.ndarray:
    """Chosen text under every element, from the last one up: parents have smaller numbers."""
    under = np.zeros(len(page.tag))
    for element, text, content in zip(elements, texts, chosen):
        under[element] += len(text) if content else 0
    for element in range(len(under) - 1, 0, -1):
        under[page.parent[element]] += under[element]
    return under


def _long_furniture(page: _Page) -> list[int]:
    """Comments and notices that go whatever their share of the page."""
    if not page.readers and not page.consent:
        return []
    count = len(page.tag)
    guarded = np.zeros(count, bool)
    for element in range(count - 1, 0, -1):
        guarded[element] |= page.tag[element] in ("h1", "article", "main")
        guarded[page.parent[element]] |= guarded[element]
    alike = Counter((page.parent[e], page.look[e]) for e in range(1, count) if page.tag[e] not in INLINE)
    repeated = np.zeros(count, bool)
    for (parent, _), n in alike.items():
        repeated[parent] |= n >= REPEATED
    for element in range(count - 1, 0, -1):
        repeated[page.parent[element]] |= repeated[element]
    return [e for e in page.readers if repeated[e] and not guarded[e]] + [e for e in page.consent if not guarded[e]]


def main_text(html: str | None) -> str:
    """The text of a whole page; empty for a null or empty page and one without content."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    if page.rawdata.startswith("<!--"):  # a comment in the markup that runs to the end of the page
        page.rawdata = ""
    page.close()
    page._flush()
    if not page.blocks:
        return ""
    elements, paths, texts, linked = zip(*page.blocks)
    fused = scores(paths, texts)
    chosen = fused >= min(fused.std(), fused.max())
    under = _chosen_under(page, elements, texts, chosen)
    dropped = np.zeros(len(page.tag), bool)
    dropped[[e for e in page.named if 2 * under[e] <= under[0]] + _long_furniture(page)] = True
    for element in range(1, len(dropped)):
        dropped[element] |= dropped[page.parent[element]]
    kept = chosen & ~dropped[list(elements)]
    if kept.any():
        under = _chosen_under(page, elements, texts, kept)
    else:  # names alone never empty a page
        dropped[:] = False
    best: dict[int, int] = {}
    for element in range(1, len(under)):
        above = page.parent[element]
        if page.tag[element] in CONTAINERS and (above not in best or under[element] > under[best[above]]):
            best[above] = element
    place = 0
    while place in best and page.tag[place] not in ("article", "main") and under[best[place]] == under[place]:
        place = best[place]
    inside = np.zeros(len(under), bool)
    inside[place] = True
    for element in range(place + 1, len(under)):
        inside[element] = inside[page.parent[element]]
    return "\n".join(
        text
        for element, text, content, links in zip(elements, texts, chosen, linked)
        if inside[element] and not dropped[element] and (content or 2 * links <= len(text))
    )


def extract(pages: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """All columns and the main text of the whole page, under the returned name.

    Null and empty pages give an empty text. Rows are independent: repeated ones come out alike.
    """
    (name,) = fresh(pages, "main_text")
    columns = pages.columns

    def run(batch):
        column = batch.column(html)
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [main_text(h.as_py()) for h in column.slice(start, 256)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*columns, name])

    return map_arrow(pages, run, with_field(pages.schema, name, StringType())), name
