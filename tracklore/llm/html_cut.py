"""Main text of web pages by a minimum cut through the blocks of a page."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes up to the end of a tag; a quote that is never closed ends the tag at the next `>` instead.
_ATTRIBUTES = r"(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|textarea|iframe|title)(?=[\s/>])" + _ATTRIBUTES + r".*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(" + _ATTRIBUTES + r")"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
#: Elements left out with what is in them; without a closing tag only their tag is. Some need none if they end in `/>`.
LEFT_OUT = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("noscript", "template", "select", "svg", "object", "math")}
SELF_CLOSED = frozenset(("svg", "math"))
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Names that say what is beside an element, not what it is: has-sidebar, no-comments.
STATE = re.compile(r"(?<!\S)(?:has|no|with|without)[-_]\S*")
#: Names that say what an article is about. They count for nothing beside a name of content, or on an article.
ABOUT = re.compile(r"(?<!\S)(?:category|cat|tag|type|format|status|topic)[-_]\S*", re.I)
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes open elements of these kinds, as far as the next one that holds them.
IMPLIED_ENDS = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",),
} | {tag: ("p",) for tag in BLOCK_TAGS - {"br", "li", "dt", "dd", "tr", "td", "th", "option", "label", "button", "html", "body"}}
HOLDERS = frozenset("ul ol menu dl table article section main div body aside nav footer header form blockquote td th".split())

#: Evidence of an element for its blocks: tags, roles and the words of class and id. Above 0 speaks for content.
TAG_COSTS = {
    "nav": -12, "footer": -12, "aside": -12, "form": -12, "menu": -12, "dialog": -12, "button": -12, "fieldset": -12, "label": -6,
    "head": -30, "header": -7, "article": 5, "main": 4, "figcaption": -1, "table": -1, "blockquote": 1,
}
ROLE_COSTS = {"navigation": -12, "banner": -9, "contentinfo": -12, "complementary": -12, "search": -12, "dialog": -12,
              "alertdialog": -12, "alert": -12, "menu": -12, "menubar": -12, "toolbar": -12, "form": -12, "main": 4, "article": 4}
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disqus feedback footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination paywall popup privacy promo promoted promotion recommended related replies "
    "reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar "
    "topbar widget widgets".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
#: An article may be a reader's comment wherever one of these stands in a name; other bad names must stand first.
COMMENT_NAMES = frozenset("comment comments reply replies".split())
BAD_NAME, GOOD_NAME, HIDDEN = -12.0, 3.0, -30.0
#: Smoothness: between neighbours in page order, and between an element and what stands in it. Across the border of an
#: element with evidence of its own the tie is weak.
NEXT, INSIDE, ACROSS = 0.6, 0.8, 0.1


class Element:
    __slots__ = ("tag", "parent", "evidence", "own", "node")

    def __init__(self, tag: str, parent: Element | None, attributes: str) -> None:
        self.tag, self.parent, self.node = tag, parent, -1
        self.own = _evidence(tag, attributes) if tag in TAG_COSTS or attributes else 0.0
        self.evidence = self.own + (parent.evidence if parent else 0.0)
        if tag == "header" and parent and parent.evidence > 0:
            # The heading of an article, not of the page.
            self.own, self.evidence = 0.0, parent.evidence


def _evidence(tag: str, attributes: str) -> float:
    cost, good, bad = float(TAG_COSTS.get(tag, 0)), False, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            value = STATE.sub(" ", value)
            about = ABOUT.sub(" ", value)
            if tag in ("article", "main") or GOOD_NAMES & {w.lower() for w in NAME_PARTS.findall(about)}:
                value = about
            words = {w.lower() for w in NAME_PARTS.findall(value)}
            if tag in ("article", "main"):
                first = {w[0].lower() for w in map(NAME_PARTS.findall, value.split()) if w}
                bad |= bool(first & BAD_NAMES or words & COMMENT_NAMES)
            else:
                bad |= bool(words & BAD_NAMES)
            good |= bool(words & GOOD_NAMES)
            if "header" in words and not words & GOOD_NAMES:
                bad = True
        elif name == "role":
            cost += ROLE_COSTS.get(value.lower(), 0)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            cost += HIDDEN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            cost += HIDDEN
    if tag in ("html", "body"):
        return min(cost, 0.0)
    return cost + (BAD_NAME if bad else GOOD_NAME if good else 0.0)


def page_blocks(page: str) -> list[tuple[str, Element, float]]:
    """(text, element, share of characters in links) of each run of text between block tags, in page order."""
    root = Element("", None, "")
    stack, blocks, text = [root], [], []
    places: dict[str, list[int]] = {}  # where in the stack the elements of a tag are; a look at it costs no walk
    link = plain = 0

    def top(tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 if none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def leave(depth: int) -> None:
        for element in stack[depth:]:
            places[element.tag].pop()
        del stack[depth:]

    def close() -> None:
        nonlocal link, plain
        words = " ".join(html.unescape("".join(text)).split()) if text else ""
        if words:
            holder = next(e for e in reversed(stack) if e.tag in BLOCK_TAGS or not e.tag)
            blocks.append((words, holder, link / max(link + plain, 1)))
        text.clear()
        link = plain = 0

    def add(piece: str) -> None:
        nonlocal link, plain
        if piece:
            text.append(piece)
            if places.get("a"):
                link += len(piece.strip())
            else:
                plain += len(piece.strip())

    done, never_closed = 0, set()
    while found := MARKUP.search(page, done):
        add(page[done : found.start()])
        done = found.end()
        tag = (found[3] or "").lower()
        if not tag:
            continue
        if tag in LEFT_OUT:
            if not found[2] and tag not in never_closed and not (tag in SELF_CLOSED and found[4].endswith("/>")):
                closing = LEFT_OUT[tag].search(page, done)
                if closing:
                    done = closing.end()
                else:
                    never_closed.add(tag)
            continue
        if tag in BLOCK_TAGS:
            close()
        if found[2]:
            depth = top((tag,))
            if depth and (tag in HOLDERS or top(HOLDERS) < depth):
                leave(depth)
            continue
        ends = IMPLIED_ENDS.get(tag, ())
        depth = top(ends)
        if depth and top(HOLDERS.difference(ends)) < depth:
            leave(depth)
        if tag not in VOID_TAGS and not found[4].endswith("/>"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(Element(tag, stack[-1], found[4][:-1].strip()))
    add(page[done:])
    close()
    return blocks


def block_cost(text: str, element: Element, links: float) -> float:
    """Evidence that a block is content (above 0) or boilerplate, as a difference of log odds."""
    cost = 0.8 * math.log2(1 + text.count(" ") + 1) - 1.6 - 4.0 * links + element.evidence
    if text[-1] in ".!?…\"”»":
        cost += 0.6
    return cost + (1.0 if element.tag in ("h1", "h2", "h3") else 0.0)


class FlowNetwork:
    """Maximum flow by shortest augmenting layers; nodes 0 and 1 are the terminals."""

    def __init__(self) -> None:
        self.edges: list[list[int]] = [[], []]
        self.to: list[int] = []
        self.room: list[float] = []

    def node(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def tie(self, a: int, b: int, there: float, back: float) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (there, back)

    def _layers(self) -> list[int]:
        layer = [-1] * len(self.edges)
        layer[0] = 0
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for edge in self.edges[node]:
                if self.room[edge] > 1e-9 and layer[self.to[edge]] < 0:
                    layer[self.to[edge]] = layer[node] + 1
                    queue.append(self.to[edge])
        return layer

    def source_side(self) -> list[bool]:
        """Which nodes are on the side of terminal 0 in a minimum cut."""
        while True:
            layer = self._layers()
            if layer[1] < 0:
                return [x >= 0 for x in layer]
            at = [0] * len(self.edges)
            path: list[int] = []
            node = 0
            while True:
                if node == 1:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    node = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.edges[node]
                while at[node] < len(edges):
                    edge = edges[at[node]]
                    if self.room[edge] > 1e-9 and layer[self.to[edge]] == layer[node] + 1:
                        break
                    at[node] += 1
                else:
                    if not path:
                        break
                    layer[node] = -1
                    node = self.to[path.pop() ^ 1]
                    continue
                path.append(edges[at[node]])
                node = self.to[path[-1]]


def label_blocks(blocks: list[tuple[str, Element, float]]) -> list[bool]:
    """Which blocks are content: the labelling of least cost.

    A block is tied to the terminals by its cost, to the next block, and to the element it stands in; elements are tied
    to the elements around them. Cutting a tie costs its strength.
    """
    network = FlowNetwork()
    nodes = []

    def element_node(element: Element) -> int:
        chain = []
        while element.node < 0:
            element.node = network.node()
            chain.append(element)
            if element.parent is None:
                break
            element = element.parent
        for one in chain:
            if one.parent is not None:
                strength = ACROSS if one.own else INSIDE
                network.tie(one.node, one.parent.node, strength, strength)
        return chain[0].node if chain else element.node

    before = None
    for text, element, links in blocks:
        node, cost = network.node(), block_cost(text, element, links)
        if cost > 0:
            network.tie(0, node, cost, 0.0)
        else:
            network.tie(node, 1, -cost, 0.0)
        network.tie(node, element_node(element), INSIDE, INSIDE)
        if before is not None:
            strength = NEXT if abs(before.evidence - element.evidence) < 1 else ACROSS
            network.tie(nodes[-1], node, strength, strength)
        nodes.append(node)
        before = element
    side = network.source_side()
    return [side[n] for n in nodes]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by a space; empty for null and empty pages and pages without content."""
    blocks = page_blocks(page or "")
    return " ".join(text for (text, _element, _links), keep in zip(blocks, label_blocks(blocks)) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page", "text", "n_chars"])


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """All rows of `pages` as (page struct without the html, text, n_chars).

    Each page is cut into blocks of text; the labelling of its blocks as content or boilerplate is a minimum cut. Character
    references are decoded, white space inside a block is one space, the content blocks are joined by a space in page
    order. Nothing is cut off: long pages are labelled whole. Null and empty pages have an empty text. Repeated rows are
    all kept, columns of any name are kept inside `page`, an empty table gives an empty result. Pages are independent, so
    this needs no shuffle.
    """
    rest = [c for c in pages.columns if c != html_column]
    packed = pages.select(F.struct(*rest).alias("page"), F.col(html_column).cast("string").alias("_html"))
    kind = packed.schema["page"].dataType.simpleString()
    return packed.mapInArrow(_extract, f"page {kind}, text string, n_chars long")
