"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks, each with its root-to-leaf tag path. Text length and punctuation are summed per
path and divided by the blocks of that path; both ratios are smoothed over neighbouring blocks of one container and
fused, together with a factor for what the path's names say. Paths whose fused ratio reaches a share of its weighted
mean are content, the others are not, whatever element they stand in. One structural rule adds to them: a short block
between content blocks of the article's element (a subheading, a list item) stays, unless it is mostly links or its
names speak against it. Everything is linear in the page, however deep its tags are nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwave.llm.base import table

#: Share of the weighted mean of the fused ratio that a path must reach.
CUT = 0.35
#: Share of the content that the article's element must hold.
HOLDS = 0.75
#: Weights of the block before, the block itself and the block after. A heading gets over CUT from the paragraph behind it.
SMOOTH = (0.3, 0.4, 0.3)
#: What a path's names multiply the fused ratio with: inside an article, no word either way, names of what goes around one.
FAVOURED, NEUTRAL, AGAINST = 4.0, 1.0, 1 / 256

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
HINTED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
SPACE = re.compile(r"\s+")
RAW = frozenset("script style noscript template svg math iframe object textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
APART = frozenset("nav footer aside form button select option dialog menu".split())
WORDS_APART = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments reply "
    "replies respond disqus cookie cookies consent notice notices notification alert popup modal overlay share sharing social related recommended newsletter subscribe subscription login signup widget "
    "toolbar pagination pager search contentinfo complementary".split()
)
ROOTS = frozenset(("article", "main"))
#: An open paragraph outside one of these stays open.
P_SCOPE = frozenset(("td", "li", "div", "article", "section", "body"))


class Element:
    __slots__ = ("depth", "factor", "number", "open_p", "parent", "path", "tag")

    def __init__(self, number: int, tag: str, parent: Element | None, path: int, factor: float) -> None:
        self.number, self.tag, self.parent, self.path, self.factor = number, tag, parent, path, factor
        self.depth = parent.depth + 1 if parent else 0
        self.open_p = tag == "p" or (parent is not None and parent.open_p and tag not in P_SCOPE)


@dataclass
class Block:
    element: Element
    text: str
    linked: int


def hints_of(attributes: str) -> list[str]:
    return [t for m in HINTED.findall(attributes) for t in re.split(r"[^a-z]+", m.lower()) if t] if attributes else []


class Page:
    """Elements and blocks of a page, in page order."""

    def __init__(self, page: str) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.elements: list[Element] = [Element(0, "", None, 0, NEUTRAL)]
        self.blocks: list[Block] = []
        self.open: dict[str, int] = {}  # by tag, how many elements are open
        self.now = self.elements[0]
        self.read(page)

    def enter(self, tag: str, attributes: str) -> None:
        hints, above = hints_of(attributes), self.now
        own = f"{tag}.{hints[0]}" if hints else tag
        path = self.paths.setdefault((above.path, own), len(self.paths) + 1)
        factor = above.factor
        if factor != AGAINST:
            against = tag in APART or (tag == "header" and factor != FAVOURED) or (tag not in ("html", "body", *ROOTS) and not WORDS_APART.isdisjoint(hints))
            factor = AGAINST if against else FAVOURED if tag in ROOTS else factor
        self.now = Element(len(self.elements), tag, above, path, factor)
        self.elements.append(self.now)
        self.open[tag] = self.open.get(tag, 0) + 1

    def leave(self, tag: str) -> None:
        """Close the innermost open element of that tag and all inside; every element closes once."""
        while True:
            closed = self.now
            self.open[closed.tag] -= 1
            self.now = closed.parent or self.elements[0]
            if closed.tag == tag:
                return

    def read(self, page: str) -> None:
        parts: list[str] = []
        links = linked = 0
        at, size = 0, len(page)

        def flush() -> None:
            nonlocal linked
            if parts:
                text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
                if text:
                    self.blocks.append(Block(self.now, text, min(linked, len(text))))
                parts.clear()
            linked = 0

        while at < size:
            m = TAG.search(page, at)
            end = m.start() if m else size
            if end > at:
                parts.append(page[at:end])
                if links:
                    linked += end - at
            if not m:
                break
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            if name in INLINE:
                continue
            if name in RAW and not closing:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at) if not attributes.endswith("/") else None
                at = stop.end() if stop else (at if attributes.endswith("/") else size)
                continue
            flush()
            if closing:
                if self.open.get(name):
                    self.leave(name)
            elif name not in VOID:
                if name in ENDS_P and self.now.open_p:
                    self.leave("p")
                elif name in ("li", "td", "th", "tr", "dt", "dd", "option") and self.now.tag == name:
                    self.leave(name)
                self.enter(name, attributes)
        flush()


def smoothed(values: np.ndarray, container: np.ndarray) -> np.ndarray:
    """Weighted mean with the neighbours that stand in the same container."""
    before, own, after = SMOOTH
    total, weight = own * values, np.full(len(values), own)
    same = container[1:] == container[:-1]
    total[1:] += np.where(same, before * values[:-1], 0)
    weight[1:] += before * same
    total[:-1] += np.where(same, after * values[1:], 0)
    weight[:-1] += after * same
    return total / weight


def chosen(found: list[Block], cut: float = CUT) -> np.ndarray:
    """For each block, whether the fused ratio of its path reaches the threshold."""
    _, path = np.unique([b.element.path for b in found], return_inverse=True)
    container = np.asarray([b.element.parent.number if b.element.parent else 0 for b in found])
    factor = np.asarray([b.element.factor for b in found])
    size = np.asarray([len(b.text) for b in found], float)
    plain = np.asarray([len(b.text) - b.linked for b in found], float)
    marks = np.asarray([len(PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0 for b in found], float)
    per_path = np.bincount(path)
    length_ratio = (np.bincount(path, plain) / per_path)[path]
    marks_ratio = ((np.bincount(path, marks) + 1) / per_path)[path]
    fused = np.sqrt(smoothed(length_ratio, container) * smoothed(marks_ratio, container)) * factor
    by_path = (np.bincount(path, fused) / per_path)[path]
    weight = size * factor
    return by_path >= cut * float((fused * weight).sum() / weight.sum())


def content(page: Page, cut: float = CUT, holds: float = HOLDS) -> list[Block]:
    """The blocks of the article."""
    found = page.blocks
    if not found:
        return []
    good = chosen(found, cut)
    if not good.any():
        return []
    held = [0] * len(page.elements)
    for b, g in zip(found, good.tolist(), strict=True):
        if g:
            held[b.element.number] += len(b.text)
    total = sum(held)
    for e in reversed(page.elements[1:]):  # children come after their parents
        held[e.parent.number] += held[e.number]
    holder = max((e for e in page.elements if held[e.number] >= holds * total), key=lambda e: e.depth)
    if holder.tag in ("p", "li", "td", "blockquote") and holder.parent:
        holder = holder.parent
    inside = [False] * len(page.elements)
    for e in page.elements:
        inside[e.number] = e is holder or (e.parent is not None and inside[e.parent.number])
    own = [i for i in np.flatnonzero(good).tolist() if inside[found[i].element.number]]
    first, last = (own[0], own[-1]) if own else (0, -1)

    def between(i: int, b: Block) -> bool:
        return first < i < last and inside[b.element.number] and b.element.factor != AGAINST and b.linked * 2 < len(b.text)

    return [b for i, b in enumerate(found) if good[i] or between(i, b)]


def main_text(page: str) -> str:
    return " ".join(b.text for b in content(Page(page)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null, empty and text-free pages give an empty text; whole pages are read, cut ones too; repeated rows get a
    row each; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
