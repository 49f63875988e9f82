"""Main text of web pages by composite text density.

Every node has a density, its characters a tag, adjusted for links; the node with the greatest sum
of its children's densities is the main text, and the least density on its path to the body is the
threshold that decides what beside it belongs to it. Names decide nothing on their own, but that
comments go, as their text is as dense as an article's: a block that is called furniture weighs a
quarter of its density, and inside the chosen text it goes if that is less than of the text around it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.session import ship_package

# Element names of HTML, and names that pages give their furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
NO_TEXT = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg math object audio video canvas select button map".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr caption ul".split())
CLOSE_P = BLOCKS - frozenset("option optgroup tbody tfoot thead tr caption body html legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT_BLOCKS = frozenset("p blockquote pre ul ol dl table figure".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo banner cookie-notice cookie-banner cookies consent newsletter "
    "subscribe signup sidebar menu navbar navigation breadcrumb breadcrumbs share sharing social social-share related related-posts recommended pagination pager toolbar paywall").split())
COMMENTS = frozenset("comment comments disqus kommentar kommentare commentaire commentaires comentario comentarios".split())
#: Elements whose own text is a part of them, like a paragraph; in others it is one run.
HOLDERS = frozenset("body html main article section div td th dd center figure form address header footer aside details".split())
#: What a name takes from the density; what a part like the chosen one needs of the threshold.
NAMED, PART = 0.25, 0.1
#: Elements open at once at most, as in browsers: what is nested deeper stands beside its parent.
DEPTH = 512

_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)(>|\Z)|</[^a-zA-Z>][^>]*+>|</>|<(?=/?[a-zA-Z])[^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(f"</{t}[^>]*+(?:>|\\Z)", re.I) for t in RAW}
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "tbody": (frozenset(["tbody", "thead", "tfoot", "tr"]), frozenset(["table"])),
}


class Node:
    __slots__ = ("tag", "parent", "children", "names", "role", "hidden", "chars", "links", "tags", "link_tags", "density", "total", "titled")

    def __init__(self, tag: str, parent: Node | None, names=frozenset(), role: str = "", hidden: bool = False):
        self.tag, self.parent, self.names, self.role, self.hidden = tag, parent, names, role, hidden
        self.children: list[Node | str] = []


def parse(html: str) -> Node:
    """The tree of a page, however broken: what is open at the end is closed, what ends without a start is ignored."""
    root = Node("html", None)
    stack, at, n = _Open(root), 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:  # a comment, a declaration, or a tag cut off
            continue
        tag = m[2].lower()
        if m[1]:
            stack.end(tag)
            continue
        if tag == "html":
            continue
        if tag in CLOSE_P:
            stack.close(frozenset(["p"]), frozenset(["table", "td", "th", "button", "object", "caption"]))
        if tag in _CLOSES:
            stack.close(*_CLOSES[tag])
        names, role, hidden = frozenset(), "", False
        if m[3] and not m[3].isspace():
            names, role, hidden = _attributes(m[3])
        node = Node(tag, stack[-1], names, role, hidden)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCKS and tag not in VOID:
            stack.open(node)
    return root


class _Open(list):
    """The elements open, outermost first, DEPTH of them at most; the count of each tag spares searches for what isn't open."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count: Counter[str] = Counter()

    def open(self, node: Node) -> None:
        if len(self) >= DEPTH:
            self.cut(len(self) - 1)
        self.append(node)
        self.count[node.tag] += 1

    def cut(self, k: int, end: int | None = None) -> None:
        for x in self[k:end]:
            self.count[x.tag] -= 1
        del self[k:end]

    def close(self, which: frozenset[str], scope: frozenset[str]) -> None:
        """Close the innermost element of which, unless one of scope is in between."""
        if not any(self.count[t] > 0 for t in which):
            return
        for k in range(len(self) - 1, 0, -1):
            if self[k].tag in which:
                self.cut(k)
                return
            if self[k].tag in scope or self[k].tag in BLOCKS and "p" in which:
                return

    def end(self, tag: str) -> None:
        if self.count[tag] <= 0:
            return
        for k in range(len(self) - 1, 0, -1):
            if self[k].tag == tag:
                # the end of an inline element leaves the blocks in it open
                self.cut(k, None if tag in BLOCKS or not any(x.tag in BLOCKS for x in self[k:]) else k + 1)
                return


def _attributes(source: str) -> tuple[frozenset[str], str, bool]:
    names, role, hidden = set(), "", False
    for name, a, b, c in _ATTRIBUTE.findall(source):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            names.update(value.lower().split())
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return frozenset(names), role, hidden


def _commented(node: Node) -> bool:
    return bool(node.names) and any(w in COMMENTS for x in node.names for w in _WORDS.findall(x))


def _below(root: Node) -> list[Node]:
    """The nodes of a tree, parents first."""
    order = [root]
    for node in order:
        order.extend(c for c in node.children if type(c) is Node)
    return order


def _prune(root: Node) -> None:
    """Drop what HTML itself calls no text, menu, footer, sidebar, form or the page's header, and comments.

    But an element with most of the page's text, or with its heading, is none of these, whatever its tag.
    """
    order = _below(root)
    for node in reversed(order):
        node.titled = node.tag in ("main", "h1", "article") or any(type(c) is Node and c.titled for c in node.children)
        node.chars = 0 if node.tag in NO_TEXT or node.hidden else sum(len(c.strip()) if type(c) is str else c.chars for c in node.children)
    most = 0.6 * root.chars
    todo = [(root, False)]
    for node, inside in todo:
        inside = inside or node.tag in ("article", "main")
        kept = []
        for c in node.children:
            if type(c) is str:
                kept.append(c)
                continue
            if c.tag in NO_TEXT or c.hidden:
                continue
            plain = c.tag in ("html", "body", "main") or c.tag in HEADINGS
            if not plain and c.chars <= most and (_commented(c) or not c.titled and (
                    c.tag in FURNITURE_TAGS or c.role in FURNITURE_ROLES or c.tag == "header" and not inside)):
                continue
            kept.append(c)
            todo.append((c, inside))
        node.children = kept


def density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Characters a tag, times the logarithm of how far they are from links, to a base that grows with links; share: of links on the page."""
    if not chars:
        return 0.0
    base = log(chars / max(1, chars - links) * links + share * chars + e) + e - 1
    return chars / max(1, tags) * max(0.0, log(chars / max(1, links) * max(1, tags) / max(1, link_tags)) / log(base))


def _measure(nodes: list[Node]) -> None:
    """The density of every node, and the sum over its children, each run of its own text counting as one.

    Tags are those of blocks and links: what only formats words says nothing about the layout.
    """
    for node in reversed(nodes):
        node.chars = node.links = node.tags = node.link_tags = 0
        for c in node.children:
            if type(c) is str:
                node.chars += len(c.strip())
            else:
                node.chars += c.chars
                node.links += c.links
                node.tags += c.tags + (c.tag in BLOCKS or c.tag == "a")
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.links = node.chars
    body = nodes[0]
    share = body.links / max(1, body.chars)
    for node in reversed(nodes):
        node.density = density(node.chars, node.links, node.tags, node.link_tags, share)
        weight = NAMED if node.names & FURNITURE_NAMES and not node.titled and node is not body else 1.0
        node.density *= weight
        own = sum(density(len(c.strip()), 0, 0, 0, share) for c in node.children if type(c) is str)
        node.total = weight * (own + sum(c.density for c in node.children if type(c) is not str))
        if node.tag not in HOLDERS and not any(type(c) is Node and c.tag in BLOCKS for c in node.children):
            node.total = min(node.total, node.density)


def _belongs(c: Node | str, chosen: Node, parent: Node, threshold: float) -> bool:
    """Whether what stands beside the chosen text, on its path to the body, is part of it."""
    if type(c) is str:
        return parent.tag != "body" and bool(c.strip())
    if c.links > 0.5 * c.chars or not c.chars:
        return False
    if c.tag in TEXT_BLOCKS:
        return c.density >= threshold and (parent.tag != "body" or c.tag == chosen.tag)
    # parts of one text are alike: articles, sections, or blocks under headings of their own
    return c.density >= PART * threshold and c.tag == chosen.tag and (c.tag in ("article", "section") or any(type(x) is Node and x.tag in HEADINGS for x in c.children))


def select(nodes: list[Node]) -> list[Node | str]:
    """What makes up the main text, in page order: the node with the greatest sum of densities, and what beside its path belongs to it."""
    best = max(nodes, key=lambda x: x.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    titled = any(x.tag == "h1" for x in _below(best))
    out: list[Node | str] = [best]
    for node, parent in zip(path, path[1:]):
        at = next(k for k, c in enumerate(parent.children) if c is node)
        before, after, touching = [], [], True
        for c in reversed(parent.children[:at]):
            if type(c) is str and not c.strip():
                continue
            found = [c] if type(c) is Node and c.tag in HEADINGS else [x for x in _below(c) if x.tag == "h1"] if type(c) is Node and c.tag in ("header", "div") and c.titled and c.chars < best.chars else []
            if found and (touching and c.tag in HEADINGS or any(x.tag == "h1" for x in found)) and not titled:
                before += found[::-1]
                titled = any(x.tag == "h1" for x in found)
            elif _belongs(c, node, parent, threshold):
                before.append(c)
            else:
                touching = False
        for k, c in enumerate(parent.children[at + 1 :], at + 1):
            if _belongs(c, node, parent, threshold):
                heading = next((x for x in parent.children[k - 1 : at : -1] if type(x) is Node or x.strip()), None)
                if type(heading) is Node and heading.tag in HEADINGS:
                    after.append(heading)
                after.append(c)
        out = before[::-1] + out + after
    return out


def _blocks(parts: list[Node | str]) -> list[str]:
    around = max(x.density for x in parts if type(x) is Node)
    whole = any(type(x) is Node and x.parent is None for x in parts)  # no element holds the text alone, so menus stand beside it
    out: list[list[str]] = [[]]
    todo: list[Node | str | None] = [y for x in reversed(parts) for y in (None, x)]
    chosen = {id(x) for x in parts}
    while todo:
        x = todo.pop()
        if x is None:
            if out[-1]:
                out.append([])
        elif type(x) is str:
            out[-1].append(x)
        elif x.tag in ("br", "td", "th", "img", "wbr"):
            if x.tag != "wbr":
                out[-1].append(" ")
            todo.extend(reversed(x.children))
        elif id(x) not in chosen and x.density < around and not x.titled and (
                x.names & FURNITURE_NAMES or whole and x.tag in ("ul", "ol", "div", "table") and x.link_tags > 1 and x.links >= 0.8 * x.chars):
            todo.append(None)
        elif x.tag in BLOCKS:
            todo.append(None)
            todo.extend(reversed(x.children))
            todo.append(None)
        else:
            todo.extend(reversed(x.children))
    return [b for b in (" ".join(unescape("".join(parts)).split()) for parts in out) if b]


def main_text(html: str) -> str:
    """The blocks of a page's main text, joined by newlines; empty if there is none."""
    root = parse(html)
    _prune(root)
    body = next((x for x in _below(root) if x.tag == "body"), root)
    body.parent = None
    nodes = _below(body)
    _measure(nodes)
    return "\n".join(_blocks(select(nodes)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of pages; null html counts as empty, whose text is empty.

    A block's white space becomes one space, blocks stand in page order with a newline between.
    Rows are independent: nulls in other columns stay, repeated rows are repeated, others are ignored.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")
