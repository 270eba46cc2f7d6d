"""Main text of web pages by tree scoring.

Paragraph-like blocks pass points for their length and commas to their ancestors, halved for each step up. A
container's points are discounted by its link density, and an article has all points below it however deep they lie;
the best container is kept, with those of its siblings that score near it or read like prose. Parts that are never
main text (menus, forms, scripts, notices, comments of readers and so on) are left out beforehand by tag, role, class
or id, unless a part so named holds most of the page's points.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Tags of HTML by how they are treated.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas form button select textarea input option nav header footer aside dialog menu audio video map title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SCORED = frozenset(("p", "pre", "blockquote", "li", "td", "dd", "div", "section", "article"))
#: An open element of the first kind ends where one of the second begins.
ENDS = {
    "p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
}
#: Words in a class, id or role that mark parts beside the article. A name counts if it consists of them, PLACED aside.
OTHERS = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|comments?|commentlist|disqus|replies|reply|respond"
ASIDE = re.compile(
    r"(?:notices?|alert|sidebar|side|widget\w*|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|pagination|pager|tags|toolbar|search|skip|complementary|contentinfo|"
    + OTHERS + ")",
    re.I,
)
BY_OTHERS = re.compile(OTHERS, re.I)
PLACED = frozenset("site top bottom left right list box bar wrap wrapper container block area links buttons posts items slot unit global primary secondary main user post".split())
#: A stray end tag of the first kind ends nothing outside an element of the second.
INLINE, FENCES = frozenset("b i a p span em strong".split()), frozenset("article body td table main".split())
TAG = re.compile("<[a-zA-Z/!?]")
COMMAS = (",", "\u060c", "\u3001")
BLANK = re.compile(r"[\s ]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "below", "chars", "linked", "run", "commas", "aside", "depth", "stop", "fence", "article")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, aside: str = ""):
        self.tag, self.parent, self.dropped, self.aside = tag, parent, dropped, aside
        # What the parser asks of the elements around is kept here, so that no open element makes it climb.
        self.depth = parent.depth + 1 if parent else 0
        self.stop: Node | None = self if tag in BLOCKS or tag in ENDS else parent.stop if parent else None
        self.fence: int = self.depth if tag in FENCES else parent.fence if parent else -1
        self.article: bool = tag == "article" or parent is not None and parent.article
        self.children: list[Node | str] = []
        self.points, self.below, self.chars, self.linked, self.run, self.commas = 0.0, 0.0, 0, 0, 0, 0


def aside(marks: str) -> str:
    """``others`` (what readers or advertisers wrote) or ``page`` if a name among the marks is of a part beside the article."""
    found = ""
    for name in marks.split():
        words = [w for w in re.split("[_-]+", name) if w and w.lower() not in PLACED]
        if words and all(ASIDE.fullmatch(w) for w in words):
            found = "others" if any(BY_OTHERS.fullmatch(w) for w in words) else found or "page"
    return found


class Tree(HTMLParser):
    """A forgiving tree: unclosed elements end with what encloses them. Each element is opened and closed once, so the
    time is in proportion to the page however its tags are nested."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", None, False)
        self.marked = False
        self.open: defaultdict[str, list[Node]] = defaultdict(list)

    def _close(self, node: Node) -> None:
        """Closes the given open element and all within."""
        at = self.at
        while True:
            self.open[at.tag].pop()
            self.at = at.parent
            if at is node:
                return
            at = at.parent

    def handle_starttag(self, tag, attrs):
        node = self.at.stop
        while node is not None:  # an implied end tag reaches through inline elements only
            if tag in ENDS.get(node.tag, ()):
                self._close(node)
                break
            if node.tag in BLOCKS:
                break
            node = node.parent.stop
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        dropped = self.at.dropped or hidden or (tag == "header" and not self.at.article) or (tag in DROPPED and tag != "header")
        node = Node(tag, self.at, dropped, aside(marks) if marks and not dropped and tag not in ("html", "body", "main") else "")
        self.marked |= bool(node.aside)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag].append(node)

    def handle_endtag(self, tag):
        if tag not in VOID and self.open[tag] and not (tag in INLINE and self.at.fence > self.open[tag][-1].depth):
            self._close(self.open[tag][-1])

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.children.append(data)


def walk(node: Node) -> Iterator[Node]:
    """Every node that isn't dropped, parents first, without recursion."""
    stack = [node]
    while stack:
        at = stack.pop()
        if not at.dropped:
            yield at
            stack.extend(c for c in reversed(at.children) if isinstance(c, Node))


def weigh(root: Node) -> list[Node]:
    """Sets chars, linked chars, points and all points below of every kept node; gives the nodes, parents first.

    ``run`` and ``commas`` are of a node's own text and that of the inline elements in it.
    """
    nodes = list(walk(root))
    for node in nodes:
        node.points = 0.0
    for node in reversed(nodes):
        own = BLANK.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.chars = len(own) + sum(k.chars for k in kids)
        node.linked = node.chars if node.tag == "a" else sum(k.linked for k in kids)
        node.below = sum(k.below for k in kids)
        inline = [k for k in kids if k.tag not in BLOCKS]
        node.run = len(own) + sum(k.run for k in inline)
        node.commas = sum(map(own.count, COMMAS)) + sum(k.commas for k in inline)
        if node.tag in SCORED and node.run:
            points, up = 1 + node.run / 100 + node.commas, node.parent
            node.below += points
            for share in (1.0, 0.5, 0.25):
                if up is None:
                    break
                up.points += points * share
                up = up.parent
    return nodes


def drop_asides(root: Node, nodes: list[Node]) -> None:
    """Drops the parts marked as beside the article, except what holds most of the page's points.

    What readers or advertisers wrote may well be longer than the article; it stays only where the rest has no points.
    """
    for node in nodes:
        if node.aside:
            rest = root.below - node.below
            node.dropped = rest > 1e-9 * root.below if node.aside == "others" else 2 * node.below <= root.below


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def score(node: Node) -> float:
    return (node.below if node.tag == "article" else node.points) * (1 - density(node))


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the given nodes, in page order, white space turned into one space."""
    out: list[list[str]] = [[]]
    stack: list = list(reversed(nodes))
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out[-1].append(at)
        elif at is None:
            out.append([])
        elif at.dropped:
            continue
        elif at.tag in ("br", "wbr"):
            out[-1].append(" " if at.tag == "br" else "")
        else:
            block = at.tag in BLOCKS
            if block:
                out.append([])
                stack.append(None)
            stack.extend(reversed(at.children))
    return [t for t in (BLANK.sub(" ", "".join(parts)).strip() for parts in out) if t]


def main_text(html: str) -> str:
    """The main text of a page: blocks joined by an empty line; empty if the page has none."""
    tree = Tree()
    end = html.rfind(">") + 1
    tree.feed(html[:end] + TAG.split(html[end:], maxsplit=1)[0])  # a tag that never ends holds no text
    tree.close()
    nodes = weigh(tree.root)
    if tree.marked:
        drop_asides(tree.root, nodes)
        nodes = weigh(tree.root)
    holders = [n for n in nodes if n.tag in BLOCKS and n.chars]
    if not holders:
        return "\n\n".join(blocks([tree.root]))
    best, kept = max(holders, key=score), []
    if best.parent is None or best.tag in ("article", "body", "html", "main"):
        kept = [best]
    else:
        for node in best.parent.children:
            if not isinstance(node, Node) or node.dropped:
                continue
            near = score(node) >= max(10.0, 0.2 * score(best))
            prose = node.tag in ("p", "pre", "blockquote") and node.chars > 80 and density(node) < 0.25
            heading = node.tag in ("h1", "h2", "h3") and density(node) < 0.5
            if node is best or near or prose or heading:
                kept.append(node)
    return "\n\n".join(blocks(kept))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` with its main ``text`` in place of ``html``; null html counts as empty.

    ``text`` is empty if there is none. Other columns stay, but for one named ``text``, which the result replaces. Each
    row is read on its own, so repeated rows get the same text and an empty table gives an empty one; of containers with
    equal points the first on the page counts. A narrow map; a page is held whole, in time in proportion to its length.
    """
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), "text"])

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], "html").mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))
