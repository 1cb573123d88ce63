"""Main text of web pages by a minimum cut.

A page is cut into blocks of text at block-level tags. A fixed linear classifier
gives each block a cost of being left out (capacity from the source) or of being
kept (capacity to the sink), from its containers, links, length and wording.
Blocks that follow each other, and blocks with the same parent, are joined by
edges whose capacity is the cost of labelling them differently and falls with
their distance in the tree. Max-flow finds the cheapest labelling; blocks on the
source side are the text.

Pages are independent rows; work is one Arrow pass without a shuffle.

Defined results: null and empty pages, and pages without content, give an empty
text; broken markup is read on: an unclosed comment, script or style runs to the
end, an end tag closes the nearest open element of its name or nothing, a "<"
that opens no tag is text. White space is what Unicode calls so, decoded
references included. Repeated rows get the same text; an empty table gives an
empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from declario.llm.common import free_name, spared

#: What HTML calls so, and words that name parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object textarea title select canvas audio video head".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr br".split()
)
CLOSES_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
BOILER_TAGS = set("nav footer aside form menu dialog button".split())
CONTENT_TAGS = {"article", "main"}
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice alert popup modal overlay newsletter subscribe subscription sidebar aside widget menu nav navbar navigation"
    " breadcrumb breadcrumbs footer header masthead share sharing social related recommended recommendations trending"
    " comment comments reply replies respond disqus discussion login signin signup register search toolbar pagination"
    " pager legal copyright disclaimer".split()
)
CONTENT_WORDS = set("article content main story post entry articlebody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("parts", "linked", "size", "boiler", "content", "tag", "parent", "depth", "text")

    def __init__(self, top: tuple, tag: str):
        self.parts: list[str] = []
        self.linked = self.size = 0
        _, self.boiler, self.content, self.parent, self.depth = top
        self.tag = tag


def blocks(html: str) -> list[Block]:
    """The page's blocks of text in order, markup resolved."""
    out: list[Block] = []
    stack = [("", 0, 0, 0, 0)]  # name, boilerplate and content containers around, number, depth
    opened: Counter[str] = Counter()  # what is on the stack, by name
    solid = [0]  # places on the stack of what isn't inline
    number = links = at = 0
    now: Block | None = None

    def add(text: str) -> None:
        nonlocal now
        if now is None:
            if not text or text.isspace():
                return
            own = stack[solid[-1]]
            above = stack[-2] if own is stack[-1] and len(stack) > 1 and own[0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else own
            now = Block((own[0], own[1], own[2], above[3], own[4]), own[0])
            out.append(now)
        if "&" in text:
            text = unescape(text)
        now.parts.append(text)
        n = len(text) - text.count(" ")
        now.size += n
        if links:
            now.linked += n

    def close_from(i: int) -> None:
        nonlocal links
        for x in stack[i:]:
            opened[x[0]] -= 1
            links -= x[0] == "a"
        del stack[i:]
        while solid[-1] >= i:
            solid.pop()

    while (m := _TOKEN.search(html, at)) is not None:
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if m["end"]:
            if tag not in INLINE:
                now = None
            if opened[tag] > 0:  # what is walked over is closed, so the walks add up to the page
                close_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in RAW and not m["attrs"].endswith("/>"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            body = None if close else re.compile(r"<body\b", re.I).search(html, at) if tag == "head" else None
            at = close.end() if close else body.start() if body else at if tag == "head" else len(html)
            continue
        if tag not in INLINE:
            now = None
        if tag in CLOSES_P:
            i = next((i for i in reversed(solid) if stack[i][0] == "p" or stack[i][0] in CLOSES_P), 0) if opened["p"] > 0 else 0
            if i and stack[i][0] == "p":
                close_from(i)
        elif tag == "li":
            i = next((i for i in reversed(solid) if stack[i][0] in ("li", "ul", "ol", "menu")), 0) if opened["li"] > 0 else 0
            if i and stack[i][0] == "li":
                close_from(i)
        if tag in VOID or m["attrs"].endswith("/>"):
            continue
        name, boiler, content, _, depth = stack[-1]
        if tag not in ("html", "body"):
            boiler += tag in BOILER_TAGS or (tag == "header" and not content)
            content += tag in CONTENT_TAGS
            if tag not in INLINE or tag == "span":
                for a in _NAMED.finditer(m["attrs"]):
                    words = set(_PARTS.findall(a[2].lower()))
                    boiler += bool(words & BOILER_WORDS)
                    content += bool(words & CONTENT_WORDS) and not words & BOILER_WORDS
        number += 1
        links += tag == "a"
        stack.append((tag, boiler, content, number, depth + 1))
        opened[tag] += 1
        if tag not in INLINE:
            solid.append(len(stack) - 1)
    if at < len(html):
        add(html[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


def gain(b: Block) -> float:
    """Positive: cost of leaving the block out. Negative: cost of keeping it."""
    n = b.text.count(" ") + 1
    z = 0.2 + 2.0 * (b.content > 0) - 4.0 * min(b.boiler, 2) + min(1.0, n / 20) - 3.0 * b.linked / max(1, b.size)
    z += 0.8 * (b.text[-1] in ".!?…。:;\"”»") + 1.0 * (b.tag == "h1") + 0.3 * (b.tag in ("h2", "h3", "p", "blockquote"))
    return z - 2.0 * b.text.startswith("©") - 1.0 * (b.tag == "li" and not b.content)


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut (Dinic's algorithm).

    A node's gain is its capacity from the source, or to the sink if negative;
    edges carry their capacity both ways.
    """
    n = len(gains)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, g in enumerate(gains):
        join(source, i, g, 0.0) if g > 0 else join(i, sink, -g, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_ = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while next_[a] < len(head[a]):
                e = head[a][next_[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                next_[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    found = blocks(html) if html else []
    gains = [gain(b) for b in found]
    if any(g > 0 for g in gains) and any(g <= 0 for g in gains):
        edges, last = [], {}
        for i, b in enumerate(found):
            if i:
                edges.append((i - 1, i, 0.5 / (1 + abs(b.depth - found[i - 1].depth))))
            if b.parent in last:
                edges.append((last[b.parent], i, 0.7))
            last[b.parent] = i
        kept = minimum_cut(gains, edges)
    else:
        kept = [g > 0 for g in gains]
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the page's ``html`` replaced by its main text, column ``out``."""
    at = pages.columns.index(html)
    rest = pages.drop(html)
    out = free_name(rest, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(at)], pa.string())
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, texts], names=[*(n for i, n in enumerate(b.schema.names) if i != at), out])

    fields = [T.StructField(f.name, f.dataType) for f in rest.schema.fields]
    return pages.mapInArrow(spared(run), T.StructType([*fields, T.StructField(out, T.StringType())]))
