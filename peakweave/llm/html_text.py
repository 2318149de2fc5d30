"""Operator 4: main text of web pages by minimum cuts.

A page becomes text blocks in order. A small linear classifier gives each block log-odds of being page text: what calling it
boilerplate costs if above 0, what calling it page text costs if below. These are its capacities to the two terminals. A block
without evidence against it is page text. Neighbouring blocks,
and consecutive blocks of one parent element, are joined by smoothness edges, weaker the farther apart
they lie in the element tree. The minimum cut (maximum flow) labels all blocks of a page at once.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[a-zA-Z][^\s/>]*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)({_NAME})([^>]*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_UNFINISHED = re.compile(r"</?[a-zA-Z]|<[!?]")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: Elements whose text is never page text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "canvas", "math", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block of text.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes implicitly if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements and class, id and role words of what is not the article.
ZONES = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset"}
WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer header masthead topbar toolbar ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search share sharing social comment comments reply replies disqus respond related recommended recommendations trending widget pagination pager copyright legal disclaimer tags meta byline complementary contentinfo".split()
)
#: What may follow such a word in a name that still means the zone (comment-list, cookie-box).
PARTS = set("list lists box bar section wrapper wrap area block container thread item items body text content inner outer link links main top bottom left right author panel row group".split())
#: How names begin that speak of other parts of the page.
ABOUT_OTHERS = ("has", "with", "no-", "without", "is-", "js-")
#: Elements and roles that hold the article, and words of classes and ids that may.
HOLDERS = {"article", "main"}
HOLDER_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}

#: The classifier's weights, log-odds that a block is page text: of any block; of each 100 characters, up to two hundred; of a sentence's end; of a heading,
#: paragraph or quotation; of a share of 1 in links, outside and inside an article; of an element or a name of a zone, and of a name that only mentions one;
#: of an article's element around the block, or elsewhere on the page; of a name that may hold the article, or elsewhere on the page.
ANY, LENGTH, SENTENCE, PROSE = 1.0, 1.0, 0.5, 0.5
LINKS, LINKS_INSIDE = -3.5, -0.5
ZONE, MENTION = -12.0, -2.0
INSIDE, OUTSIDE, NAMED_INSIDE, NAMED_OUTSIDE = 3.0, -6.0, 1.5, -2.5
#: The edges' capacities: neighbours in order, consecutive under one parent; divided by their distance in the tree.
NEAR, SIBLING = 0.4, 0.5


def zone_evidence(tokens: list[str]) -> float:
    """Of names in class, id, role: ZONE if one is a zone's, MENTION if one only has such a word in it, else 0."""
    found = 0.0
    for t in tokens:
        parts = _WORD.findall(t)
        hits = [p in WORDS for p in parts]
        if any(hits) and not t.startswith(ABOUT_OTHERS):
            if parts[-1] == "header" and any(p in HOLDER_WORDS for p in parts):
                continue  # the article's own heading
            if hits[-1] or (hits[0] and all(p in PARTS or p in WORDS for p in parts[1:])):
                return ZONE
            found = MENTION
    return found


class Element:
    """An open element: its name, the evidence on it (zone: 0 or less; article: 2 by element, 1 by name), its depth and parent."""

    __slots__ = ("block", "depth", "holder", "name", "parent", "zone")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.parent = name, parent
        self.block = self if name in BLOCK or parent is None else parent.block
        self.depth = parent.depth + 1 if parent else 0
        self.zone, self.holder = (parent.zone, parent.holder) if parent else (0.0, 0)
        tokens: list[str] = []
        if attributes:
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    self.zone = ZONE
                elif key in ("class", "id", "role", "aria-label"):
                    tokens += value.split()
        if name in HOLDERS or "main" in tokens and 'role="main"' in attributes.lower().replace("'", '"').replace(" ", ""):
            self.holder = 2
        elif name in ZONES or (name == "header" and self.holder < 2):
            self.zone = ZONE
        elif tokens and name not in ("body", "html"):
            evidence = zone_evidence(tokens)
            self.zone = min(self.zone, evidence)
            if not evidence and any(p in HOLDER_WORDS for t in tokens for p in _WORD.findall(t)):
                self.holder = max(self.holder, 1)


def text_blocks(html: str) -> list[tuple[str, int, Element]]:
    """(text, characters in links, innermost block element) of each block with text, in page order."""
    root = Element("html", "", None)
    stack, out, parts, linked, links = [root], [], [], 0, 0
    at = 0

    opened: dict[str, list[int]] = {}  # places in the stack by name; some may be gone

    def place_of(name: str) -> int:
        held = opened.get(name, [])
        while held and (held[-1] >= len(stack) or stack[held[-1]].name != name):
            held.pop()
        return held[-1] if held else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = _SPACE.sub(" ", "".join(parts)).strip()
            if joined:
                out.append((joined, linked, stack[-1].block))
            parts.clear()
        linked = 0

    closed = html.rfind(">")

    def text(piece: str) -> None:
        nonlocal linked
        parts.append(unescape(piece))
        if links:
            linked += len(piece.strip())

    while True:
        i = html.find("<", at)
        m = _TOKEN.match(html, i) if 0 <= i <= closed or html.startswith("<!--", i) else None
        if m is None:
            if i < 0 or (i > closed and _UNFINISHED.match(html, i)):  # a tag that the page's end cuts is no text
                text(html[at:] if i < 0 else html[at:i])
                break
            text(html[at : i + 1])
            at = i + 1
            continue
        if i > at:
            text(html[at:i])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name, closing, attributes = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if closing:
            if name in RAW:
                continue
            if name in BLOCK:
                flush()
            elif name == "a":
                links = max(0, links - 1)
            k = place_of(name)
            if k and (name in BLOCK or stack[-1].block.depth <= k):
                del stack[k:]
            continue
        if name in RAW:
            if attributes.rstrip().endswith("/"):
                continue
            if name in ("title", "script", "style", "textarea", "noscript", "iframe", "template", "object", "svg", "canvas", "math", "audio", "video"):
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            for closes in ({"p"}, CLOSES.get(name, set())):
                if (inner := stack[-1].block).name in closes:
                    del stack[inner.depth :]
        elif name == "a":
            links += 1
        if not attributes.rstrip().endswith("/"):
            opened.setdefault(name, []).append(len(stack))
            stack.append(Element(name, attributes, stack[-1]))
    flush()
    return out


def evidence(text: str, linked: int, element: Element, holder: int) -> float:
    """The block's log-odds of being page text. holder: the strongest sign of an article's element on the page."""
    share = min(1.0, linked / len(text))
    out = ANY + min(2.0, LENGTH * len(text) / 100) * (1 - share) + (SENTENCE if text[-1] in ".!?…:;\"”»" else 0.0) + element.zone
    if element.name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figcaption"):
        out += PROSE
    out += share * (LINKS_INSIDE if element.holder else LINKS)
    if holder == 2:
        return out + (INSIDE if element.holder == 2 else OUTSIDE)
    if holder:
        return out + (NAMED_INSIDE if element.holder else NAMED_OUTSIDE)
    return out


def apart(a: Element, b: Element, most: int = 16) -> int:
    """1 for blocks of one parent, more the farther apart in the tree, up to ``most``."""
    steps = 0
    while a is not b and steps <= most:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        steps += 1
        if a.parent is None and b.parent is None:
            break
    return max(1, steps - 1)


def minimum_cut(to_source: list[float], to_sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut (of several, that with fewest), by maximum flow.

    to_source, to_sink: each node's terminal capacities; edges: (i, j) -> capacity in both directions.
    Nodes whose terminals differ by more than all their edges together have their side already; they hand
    their edges on to their neighbours as terminal capacities. That parts the rest into pieces, in each of which
    flow is sought on its own.
    """
    n = len(to_source)
    net = [a - b for a, b in zip(to_source, to_sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(net[i]) > sum(near[i].values()) + 1e-12:
            side[i] = net[i] > 0
            for j, c in near[i].items():
                net[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i].clear()
    for i in range(n):
        if side[i] is None:
            piece, queue = {i: 0}, [i]
            for j in queue:
                for k in near[j]:
                    if k not in piece:
                        piece[k] = len(piece)
                        queue.append(k)
            for j, at_source in zip(queue, _reached([net[j] for j in queue], [{piece[k]: c for k, c in near[j].items()} for j in queue]), strict=True):
                side[j] = at_source
    return [bool(x) for x in side]


def _reached(net: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which nodes the source still reaches once the flow is greatest. net: what each node gets from the source, or, below 0, can give to the sink.

    Blocking flows over the shortest ways that are left, in rounds of growing length.
    """
    n, least = len(net), 1e-12
    residual = [dict(x) for x in near]
    while True:
        level = [0 if x > least else -1 for x in net]
        queue, end = [i for i in range(n) if level[i] == 0], -1
        for i in queue:
            if end >= 0 and level[i] >= end:
                break
            for j, c in residual[i].items():
                if c > least and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
                    if net[j] < -least:
                        end = level[j]
        if end < 0:
            return [x >= 0 for x in level]
        ways = [list(x) for x in residual]
        for start in range(n):
            if level[start]:
                continue
            path = [start]
            while path and net[start] > least:
                i = path[-1]
                if net[i] < -least and len(path) > 1:
                    flow = min(net[start], -net[i], min(residual[a][b] for a, b in zip(path, path[1:], strict=False)))
                    net[start] -= flow
                    net[i] += flow
                    for a, b in zip(path, path[1:], strict=False):
                        residual[a][b] -= flow
                        residual[b][a] += flow
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if residual[a][b] <= least), None)
                    del path[(full + 1) if full is not None else 1 :]
                elif ways[i]:
                    j = ways[i][-1]
                    if level[j] == level[i] + 1 and residual[i][j] > least and (level[j] < end or net[j] < -least):
                        path.append(j)
                    else:
                        ways[i].pop()
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def main_text(html: str) -> str:
    """The article's blocks, joined by an empty line."""
    blocks = text_blocks(html)
    if not blocks:
        return ""
    holder = max((e.holder for _, _, e in blocks if e.zone > ZONE), default=0)
    odds = [evidence(*b, holder) for b in blocks]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (_, _, e) in enumerate(blocks):
        if i:
            edges[i - 1, i] = NEAR / apart(blocks[i - 1][2], e)
        over = id(e.parent)
        if over in last:
            edges[last[over], i] = edges.get((last[over], i), 0.0) + SIBLING
        last[over] = i
    content = minimum_cut([max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds], edges)
    return "\n\n".join(t for (t, _, _), keep in zip(blocks, content, strict=True) if keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: id_col, the columns to keep, text and n_chars (code points).

    Null or empty html gives an empty text, 0 characters; null ids stay null. Pages of any length are read whole, in time
    about in proportion. Repeated rows each get a row; an empty table gives an empty table; columns not named are not read.
    """
    source = pages.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    names = [*source.columns[:-1], "text", "n_chars"]

    def run(batches):
        for b in batches:
            found = [main_text(h.as_py() or "") for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=names)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = source.mapInArrow(run, f"{shape}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
