"""Main text of web pages by line-block distribution.

Markup is stripped so that every block of the page becomes one line.  Elements that never
hold the article (menus, footers, forms, adverts, comments, ...) leave a gap of empty lines
as wide as the window.  Over the lines, the text lengths (link text does not count) are
summed in sliding windows of three lines: the text surges where a sum rises from zero to a
long block and dives where the sum is zero again.  What lies between is kept whole, short
paragraphs included, and so are short parts of the same container that an advert cut off and
linked headings beside kept text.  Text in <article> or <main> counts twice; text elsewhere stays in the choice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tenderlens.llm.common import chunks

WINDOW = 3
ARTICLE = 2  # weight of a character inside <article> or <main>
SURGE = 80  # characters in a window from which short blocks around it count as article
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|math|select|textarea|button)\b"
    r"[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[a-zA-Z/][^>]*\Z",
    re.S | re.I)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split())
_BOILERPLATE = frozenset("head nav header footer aside form menu dialog".split())
_CONTAINER = frozenset("div section ul ol table p span figure details article li".split())
_NAMES = re.compile(
    r"""(?:class|id|role|data-role)\s*=\s*["']?[^"'>]*(?<![a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*"""
    r"""|breadcrumbs?|sidebar|side-bar|footer|header|masthead|cookies?|consent|notice|newsletter|subscribe|signup|popup|modal"""
    r"""|comments?|comment-\w+|disqus\w*|replies|related|recommend\w*|share|sharing|social|widget|toolbar|pagination)(?![a-z])""",
    re.I)
_HOLDER = frozenset("article aside blockquote body center dd details dialog div fieldset figure main section td".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str = ""
    own: int = 0  # weighted length without link text
    path: tuple[int, ...] = ()  # open containers, outermost first
    heading: bool = False
    inside: bool = False  # of <article> or <main>


def page_lines(page: str) -> list[Line]:
    """The page's blocks; lines without text are gaps."""
    gap = [Line()] * WINDOW
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0  # characters of the current line inside links
    skip, depth, in_link, inside, heading = "", 0, False, 0, False
    within: list[str] = []  # blocks open inside a skipped li
    holders: list[tuple[str, tuple[int, ...]]] = [("", (0,))]
    n_holders = 0

    def flush() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            own = max(len(text) - linked, 0) * (ARTICLE if inside else 1)
            lines.append(Line(text, own, holders[-1][1], heading, inside > 0))
        parts, linked = [], 0

    at = 0
    for m in _TOKEN.finditer(page):
        if not skip and m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            linked += len(piece) if in_link and not inside else 0
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[2]), m[4] or ""
        if skip == "p" and name in _BLOCK and not (closing and name == "p"):
            skip = ""  # its end tag may be omitted before a block and at the end of its parent
        elif skip == "li" and name in _BLOCK:
            if closing and name in within:
                while within.pop() != name:
                    pass
            elif closing and name not in ("li", "p") or name == "li" and not closing and not within:
                skip = ""
            elif not closing and name not in ("li", "p", "hr"):
                within.append(name)
        if skip:
            if name == skip and not (skip == "li" and within):
                depth += -1 if closing else 1
            elif name in ("article", "main") and not closing and not inside:
                depth = 0  # an unclosed menu does not swallow the article
            elif name == "body" and skip == "head":
                depth = 0
            if depth > 0:
                continue
            skip = ""
            if closing:
                continue
        if not closing and name not in _VOID and not attributes.rstrip().endswith("/") and (
                (name in _BOILERPLATE and not (name == "header" and inside)) or
                (name in _CONTAINER and _NAMES.search(attributes))):
            flush()
            lines.extend([] if inside else gap)  # an aside does not cut the article in two
            skip, depth, within = name, 1, []
            heading = False
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            flush()
            heading = name in _HEADING and not closing
            if name in _HOLDER and not closing:
                n_holders += 1
                holders.append((name, (*holders[-1][1], n_holders)))
            elif closing and any(held == name for held, _ in holders):
                while holders.pop()[0] != name:
                    pass
            if name in ("article", "main"):
                if not inside:
                    lines.extend(gap)
                inside = max(inside + (-1 if closing else 1), 0)
                if not inside:
                    lines.extend(gap)
    if not skip:
        parts.append(page[at:])
    flush()
    return lines


def _trimmed(lines: list[Line], start: int, end: int) -> tuple[int, int]:
    """A region from its first to its last line with text of its own, and the headings beside these."""
    a, b = start, end
    while a < b and not lines[a].own:
        a += 1
    while a < b and not lines[b - 1].own:
        b -= 1
    if a < b:
        while a > 0 and lines[a - 1].heading:
            a -= 1
        while b < len(lines) and lines[b].heading and lines[b].path == lines[b - 1].path:
            b += 1
    return a, b


def _kept(lines: list[Line], regions: list[tuple[int, int]], high: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The high regions and the short ones of their containers, in page order.

    Short regions are kept with a high region in their innermost container, between two high
    regions of a container around them, and in an article when an article holds a high region.
    """
    first: dict[int, int] = {}  # container: its first and last high line
    last: dict[int, int] = {}
    in_article = False
    for a, b in high:
        for i in range(a, b):
            if lines[i].own:
                first.setdefault(lines[i].path[-1], i)
                last[lines[i].path[-1]] = i
                in_article |= lines[i].inside
    chosen, out = set(high), []
    for a, b in regions:
        held = [line for line in lines[a:b] if line.own]
        if (a, b) in chosen or any(
                line.path[-1] in first or (in_article and line.inside) or any(
                    c in first and first[c] < a <= last[c] for c in line.path) for line in held):
            out.append((a, b))
    return out


def main_text(page: str) -> str:
    """Blocks between surge and dive points, in page order, joined by one space."""
    lines = page_lines(page)
    sums = [sum(line.own for line in lines[i:i + WINDOW]) for i in range(len(lines))]
    regions: list[tuple[int, int]] = []  # between two dives: maximal parts without a silent window
    start = None
    for i, line in enumerate(lines):
        if sums[i] > 0 or (line.text and start is not None):
            start = i if start is None else start
        elif start is not None:
            regions.append((start, i))
            start = None
    if start is not None:
        regions.append((start, len(lines)))
    regions = [r for r in (_trimmed(lines, a, b) for a, b in regions) if r[0] < r[1]]
    if not regions:
        return " ".join(line.text for line in lines if line.text)  # nothing but links
    high = [(a, b) for a, b in regions if max(sums[a:b]) >= SURGE]
    if not high:  # a page of short blocks only: its longest part is the article
        high = [max(regions, key=lambda r: (sum(line.own for line in lines[r[0]:r[1]]), -r[0]))]
    kept = sorted({i for a, b in _kept(lines, regions, high) for i in range(a, b)})  # two may share headings
    return " ".join(lines[i].text for i in kept if lines[i].text)


def extract(pages: DataFrame, markup: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text``: the main text of every page; null or empty markup gives an empty text.

    Rows and other columns stay; an earlier column of that name is replaced.  Pages are read
    one by one, whole, whatever their length.
    """
    pages = pages.drop(text) if text != markup else pages
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, markup):
            found = [main_text(p or "") for p in batch.column(batch.schema.get_field_index(markup)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             [*batch.schema.names, text])

    return pages.mapInArrow(run, schema)
