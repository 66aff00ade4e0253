"""Main text of web pages from streaming parser events.

The standard-library parser gives events; text between block boundaries is a line with its text-to-tag ratio.  The
ratios are smoothed with a Gaussian, lines above a threshold cluster as content, and the container that holds the
cluster is the content region.  All lines of the region are kept, short ones too, but those of page furniture.

Scale: pages are independent and stay where they lie; a task holds one page's lines at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sonorisk.llm.common import nested, small

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside blockquote caption center dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li menu nav ol option p pre search summary table tbody tfoot th thead tr ul".split()
)
FURNITURE = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu search audio video datalist".split())
UNSEEN = FURNITURE - frozenset("nav footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|related|recommended|share|sharing|social|"
    r"comments?|commentlist|replies|respond|disqus|login|signup|pagination|pager)(?:$|[\s_-])",
    re.IGNORECASE,
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PIECE = 1 << 20


class LineParser(HTMLParser):
    """Collects lines: pieces of text, tags in and around them, innermost container.

    A piece carries the innermost furniture element around it (0: none).  An element that turns out to hold the page's
    article or main is no furniture, which is known at the end only; what is never seen is left out at once.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, innermost furniture element (-1: never seen), container
        self.open: Counter[str] = Counter()
        self.parent, self.kind = [-1], ["root"]
        self.around, self.holds, self.wraps = [-1], [True], [True]  # per furniture element: the one around it, holds an article, may hold a page
        self.free = False  # an article or main stands outside furniture
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []
        self.text: list[tuple[str, int, bool]] = []  # text, furniture element, linked
        self.tags = 0

    def _line(self) -> None:
        if any(not x.isspace() for x, _, _ in self.text):
            self.lines.append((self.text, self.tags, self.stack[-1][2] if self.stack else 0))
        self.text, self.tags = [], 0

    def _pop(self, tag: str) -> None:
        while True:
            top = self.stack.pop()[0]
            self.open[top] -= 1
            if top == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._line()
            if self.open["p"]:
                self._pop("p")
            if self.stack and self.stack[-1][0] in CLOSED_BY.get(tag, ()):
                self._pop(self.stack[-1][0])
        self.tags += 1
        if tag == "br":
            self.text.append((" ", 0, False))
        if tag in VOID:
            return
        _, out, container = self.stack[-1] if self.stack else ("", 0, 0)
        inner = self.open["article"] or self.open["main"]
        names = dict(attrs)
        if tag in UNSEEN or "hidden" in names:
            out = -1
        elif out >= 0:
            plain = tag in FURNITURE or (tag == "header" and not inner) or (names.get("role") or "").lower() in ROLES
            named = tag not in ("html", "body", "main") and not (tag == "article" and not inner) and NAMES.search(f"{names.get('class') or ''} {names.get('id') or ''}")
            if plain or named:
                self.around.append(out)
                self.holds.append(False)
                self.wraps.append(tag == "form" or not plain)
                out = len(self.around) - 1
            if tag in ("article", "main") and not inner:
                self.free = self.free or out == 0
                f = out
                while f > 0 and not self.holds[f]:
                    self.holds[f], f = True, self.around[f]
        if tag in CONTAINERS:
            self.parent.append(container)
            self.kind.append(tag)
            container = len(self.parent) - 1
        self.stack.append((tag, out, container))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._line()
        if self.open[tag]:
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        out = self.stack[-1][1] if self.stack else 0
        if out >= 0:
            self.text.append((data, out, self.open["a"] > 0))

    def close(self) -> None:
        super().close()
        self._line()

    def seen(self) -> list[tuple[str, int, int, int]]:
        """Lines outside furniture: text, tags, linked characters, container.

        Where no article or main stands outside furniture, the furniture around one is none; where there is none at all,
        neither are forms and named elements around most of the unlinked text.
        """
        page = [True] + [False] * (len(self.around) - 1)
        if not self.free and any(self.holds[1:]):
            page = self.holds
        elif not self.free:
            size = [0] * len(self.around)
            for pieces, _, _ in self.lines:
                for x, f, linked in pieces:
                    size[f] += 0 if linked else len("".join(x.split()))
            for f in range(len(size) - 1, 0, -1):  # an element comes after the one around it
                size[self.around[f]] += size[f]
            for f in range(1, len(size)):
                page[f] = page[self.around[f]] and self.wraps[f] and 2 * size[f] > size[0]
        out = []
        for pieces, tags, container in self.lines:
            kept = [(x, linked) for x, f, linked in pieces if page[f]]
            text = " ".join("".join(x for x, _ in kept).split())
            if text:
                out.append((text, tags, sum(len(x) for x, linked in kept if linked), container))
        return out


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends the kernel is renormalised."""
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    cut = slice(radius, radius + len(ratios))
    return np.convolve(ratios, kernel)[cut] / np.convolve(np.ones(len(ratios)), kernel)[cut]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.8) -> str:
    """Text of the content region; empty for NULL, empty and text-free pages.

    The region is the innermost container with ``share`` of the clustered characters, widened to its outermost article
    or main element, or else to the container of all clustered lines that are not links.  Outside an article or main
    element, short lines of links alone are menus.
    """
    if not html:
        return ""
    p = LineParser()
    for at in range(0, len(html), PIECE):
        p.feed(html[at : at + PIECE])
    p.close()
    lines = p.seen()
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], dtype=float)
    raw = size / np.array([max(1, x[1]) for x in lines])
    ratio = smoothed(raw, sigma)
    least = min(ratio.std(), ratio.max())
    content = ratio >= least
    menu = np.array([x[2] >= 0.9 * len(x[0]) for x in lines]) & (raw < least)
    weight, own = np.zeros(len(p.parent)), np.zeros(len(p.parent))  # clustered characters; those of them outside menus
    for (_, _, _, c), s, on, alone in zip(lines, size, content, content & ~menu, strict=True):
        weight[c] += s * on
        own[c] += s * alone
    for c in range(len(p.parent) - 1, 0, -1):  # a container comes after its parent
        weight[p.parent[c]] += weight[c]
        own[p.parent[c]] += own[c]
    region = max(c for c in range(len(p.parent)) if weight[c] >= share * weight[0])
    c = region
    while c >= 0:
        if p.kind[c] in ("article", "main"):
            region = c
        c = p.parent[c]
    if p.kind[region] not in ("article", "main"):
        while region > 0 and own[region] < own[0]:
            region = p.parent[region]
    inside = np.zeros(len(p.parent), dtype=bool)
    for c in range(len(p.parent)):
        inside[c] = c == region or (c > 0 and inside[p.parent[c]])
    loose = p.kind[region] not in ("article", "main")
    return " ".join(t for (t, _, _, c), m in zip(lines, menu, strict=True) if inside[c] and not (loose and m))


def extract_main_text(pages: DataFrame, keep: Sequence[str] | None = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``doc`` (kept columns), ``text`` and ``n_chars`` (code points) for every row.

    A NULL or empty page, and one without text, has an empty text.  Repeated rows are extracted once a row; no rows
    give none.
    """
    rows = nested(pages, keep, t=html)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([main_text(x) for x in b.column("t").to_pylist()], pa.string())], names=["doc", "text"])

    out = rows.mapInArrow(extract, T.StructType([rows.schema["doc"], T.StructField("text", T.StringType())]))
    return out.select("doc", "text", F.char_length("text").cast("long").alias("n_chars"))
