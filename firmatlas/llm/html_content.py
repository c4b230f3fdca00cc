"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. For each block a small linear classifier gives the cost of calling it
boilerplate and the cost of calling it content, from the elements around it, their class names, its length,
its share of link text and its punctuation; these are the capacities to the two terminals. Blocks that follow each
other are tied by an edge that grows with the part of the DOM path they share, blocks with the same parent by
another. The minimum cut, found by maximum flow, is the labelling with the least total cost, so a short block
inside an article stays with it and a long one in a sidebar does not.

Defined results: a null, empty or text-free page gives an empty text; broken, unclosed and cut-off markup is read
as far as it goes; repeated rows are each extracted; other columns pass through, and one with the name of the
result is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from firmatlas.llm.common import rows_in_slices, shipped, with_column

# fixed values: element names of HTML by what they do to a text, and words in class names
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title noscript template svg iframe canvas object audio video math textarea select button datalist".split())
SECTIONS = frozenset("p h1 h2 h3 h4 h5 h6".split())
ASIDE_TAGS = frozenset("nav footer aside form dialog menu search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social related recommended recommendations teaser comment comments disqus respond replies reply pagination "
    "pager toolbar widget copyright legal".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story body text".split())
WRAPPERS = frozenset("has with no layout wrapper page container site outer inner".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
STOCK = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bsubscribe\b|\bsign (?:in|up)\b|\bread more\b|\bterms of (?:use|service)\b", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    tag: str
    number: int
    aside: bool
    main: bool


@dataclass
class Block:
    text: str
    linked: int
    path: tuple[int, ...]
    tag: str
    aside: bool
    main: bool


def _named(attributes: str) -> tuple[set[str], set[str]]:
    """Words of class and id, and roles."""
    words, roles = set(), set()
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            roles.add(value.strip().lower())
        else:
            for part in value.split():
                found = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", part))}
                if not found & WRAPPERS:
                    words |= found
    return words, roles


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    found: list[Block] = []
    stack = [Element("", 0, False, False)]
    parts: list[tuple[str, bool]] = []
    numbers, links, at = 0, 0, 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = len(" ".join(" ".join(entities.unescape(p) for p, link in parts if link).split()))
            found.append(
                Block(text, linked, tuple(e.number for e in stack if e.tag in BLOCKS or not e.tag), stack[-1].tag, any(e.aside for e in stack), any(e.main for e in stack))
            )
        parts.clear()

    def pop_to(tag: str) -> None:
        nonlocal links
        while stack[-1].tag != tag:
            links -= stack.pop().tag == "a"
        links -= stack.pop().tag == "a"

    while at < len(page):
        m = _TAG.search(page, at)
        parts.append((page[at : m.start()] if m else page[at:], links > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                close()
            if any(e.tag == tag for e in stack):
                pop_to(tag)
            continue
        if tag in UNREAD:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append((" ", False))
            continue
        if tag in VOID:
            parts.append((" ", False))
            if tag in BLOCKS:
                close()
            continue
        if tag in BLOCKS:
            close()
            open_tags = [e.tag for e in stack]
            for section in SECTIONS:  # a block ends an open paragraph or heading
                if section in open_tags and section in (e.tag for e in stack):
                    pop_to(section)
            if tag in ("li", "tr", "td", "th", "dt", "dd") and stack[-1].tag == tag:
                stack.pop()
        words, roles = _named(m[3]) if m[3] else (set(), set())
        inside = any(e.main for e in stack)
        aside = tag in ASIDE_TAGS or bool(words & ASIDE_WORDS) or bool(roles & ASIDE_ROLES) or (tag == "header" and not inside)
        numbers += 1
        stack.append(Element(tag, numbers, aside and tag not in ("body", "html"), tag in MAIN_TAGS or "main" in roles or bool(words & MAIN_WORDS and tag in BLOCKS)))
        links += tag == "a"
    close()
    return found


def costs(found: list[Block]) -> list[tuple[float, float]]:
    """(cost of calling it boilerplate, cost of calling it content) per block."""
    marked = any(b.main and not b.aside for b in found)
    out = []
    for b in found:
        words = b.text.count(" ") + 1
        plain = 1 - min(1.0, b.linked / len(b.text))
        ended = b.text[-1] in ".!?:;\"”"
        content = 0.5 + plain * (min(words, 60) / 12 + ended) + (2 if b.tag in SECTIONS else 0) + (12 if b.main else 0)
        boiler = 0.5 + 5 * (1 - plain) + (1.5 if words < 4 else 0) + (3 if words < 40 and STOCK.search(b.text) else 0)
        boiler += (60 if b.aside else 0) + (14 if marked and not b.main else 0)
        out.append((content, boiler))
    return out


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """(block, block, capacity) of neighbours in the text and of neighbours among the children of an element."""
    out, last = [], {}
    for i, b in enumerate(found):
        parent = b.path[-2] if len(b.path) > 1 else 0
        if i:
            before = found[i - 1].path
            shared = next((k for k, (x, y) in enumerate(zip(before, b.path, strict=False)) if x != y), min(len(before), len(b.path)))
            out.append((i - 1, i, 2.0 * shared / max(len(before), len(b.path))))
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, 1.0))
        last[parent] = i
    return out


def cut(terminals: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the content side of the minimum cut (shortest augmenting paths in levels)."""
    n = len(terminals)
    source, sink = n, n + 1
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, (content, boiler) in enumerate(terminals):  # what both terminals offer flows straight through
        if content > boiler:
            arc(source, i, content - boiler, 0)
        elif boiler > content:
            arc(i, sink, boiler - content, 0)
    for a, b, w in edges:
        if w > 0:
            arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, a = [], source
                continue
            while tried[a] < len(arcs[a]):
                e = arcs[a][tried[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(arcs[a]):
                path.append(arcs[a][tried[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


def main_blocks(page: str | None) -> list[str]:
    found = blocks(page) if page else []
    return [b.text for b, kept in zip(found, cut(costs(found), ties(found)), strict=True) if kept] if found else []


def extract(pages: DataFrame, html: str = "html", out: str = "blocks") -> DataFrame:
    """``pages`` with the blocks of each page's main text, in page order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in_slices(batches, html):
            yield with_column(batch, out, pa.array([main_blocks(p) for p in batch.column(html).to_pylist()], type=pa.list_(pa.string())))

    kept = [f for f in pages.schema.fields if f.name != out]
    return shipped(pages).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType()))]))
