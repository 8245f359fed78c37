"""Main text of web pages by composite text density.

A page is parsed into a tree. For each node: characters per tag, weighted by how few of them stand in links (Sun, Song
and Liao 2011), and the sum of its children's densities. The node of the greatest sum is the content's core; the smallest
density on the path from it to the body is the threshold that a branch must reach to hold content.

Elements that say of themselves that they are page furniture (navigation, footers, adverts, forms and so on) are left out
of the densities, since a short article has no density to stand out by. That is a mark and no verdict: it falls where the
page's text, or the greater part of it in an article or main element, would go with the element.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.workspace import ship

#: HTML's void elements, raw-text elements, and what opens a block of its own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text, and elements that mostly don't, of which some may hold it all the same.
NEVER = frozenset("head script style noscript template button select option textarea iframe object svg canvas audio video map title noembed noframes".split())
APART = frozenset("nav footer aside dialog menu".split())
MOSTLY_APART = frozenset("form header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of class and id values that name page furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense banner banners sponsor sponsored promo promos promotion promoted"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar toolbar pagination pager"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login"
    " comment comments disqus replies respond share sharing social related recommended recommendations widget widgets skip".split()
)
#: Starting one of the first closes an open one of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())

_TOKEN = re.compile(r"<!--(?:.*?--!?>|>|->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"']+)))?")
_NAME = re.compile(r"[A-Za-z]+")
#: Marks of furniture: it never holds main text; it doesn't; it mostly doesn't.
HIDDEN, FURNITURE, LIKELY = 3, 2, 1
#: The mark of an element falls if all that is outside of marked elements is less than this share of its own text.
OUTSIDE = 0.02


class Node:
    __slots__ = ("tag", "children", "parent", "mark", "cut", "chars", "tags", "link_chars", "link_tags", "loose", "density", "total", "order", "end")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0):
        self.tag, self.parent, self.mark, self.cut = tag, parent, mark, mark == HIDDEN
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.loose = 0
        self.density = self.total = 0.0
        self.order = self.end = 0


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    """What an element says of itself: by its name, and by attributes of exactly these names."""
    if tag in NEVER:
        return HIDDEN
    mark = FURNITURE if tag in APART else LIKELY if tag in MOSTLY_APART and not (tag == "header" and in_article) else 0
    if not attributes or tag in ("html", "body", "article", "main"):
        return mark
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" and tag not in INLINE:
            return HIDDEN
        if name == "role" and value in ROLES:
            mark = max(mark, FURNITURE)
        elif name in ("class", "id") and any(w in NAMES for w in _NAME.findall(value)):
            mark = max(mark, LIKELY)
    return mark


#: Formatting inside doesn't keep a paragraph open; these do.
_BARRIER = frozenset("#root html body table td th caption button object article section div main li ul ol blockquote".split())


class _Open:
    """The open elements; where each kind is open is known, so that no tag costs more than the elements it closes."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)
        self.blocks, self.barriers = [0], [0]  # elements that an end of formatting, a paragraph's end doesn't reach beyond

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.at[node.tag].append(k)
        if node.tag not in INLINE and node.tag != "p":
            self.blocks.append(k)
        if node.tag in _BARRIER:
            self.barriers.append(k)
        self.stack.append(node)

    def close_to(self, k: int) -> None:
        """Close the k-th element and all that are open in it."""
        while len(self.stack) > max(1, k):
            node = self.stack.pop()
            self.at[node.tag].pop()
            for held in (self.blocks, self.barriers):
                if held[-1] == len(self.stack):
                    held.pop()

    def has_paragraph(self) -> bool:
        return bool(self.at["p"]) and self.at["p"][-1] > self.barriers[-1]

    def close(self, tag: str) -> None:
        """An end tag; one that stands for nothing, or for formatting outside of the block, closes nothing."""
        if self.at[tag] and (tag not in INLINE or self.at[tag][-1] > self.blocks[-1]):
            self.close_to(self.at[tag][-1])

    def close_any(self, tags: set[str], scope: set[str]) -> None:
        """Close the outermost of the tags that is open within the innermost of the scope."""
        least = max((self.at[t][-1] for t in scope if self.at[t]), default=0)
        found = [self.at[t][i] for t in tags if (i := bisect.bisect_right(self.at[t], least)) < len(self.at[t])]
        if found:
            self.close_to(min(found))


def parse(source: str) -> Node:
    """The tree of a page, in time proportional to its length. Never fails: what isn't markup is text, what isn't closed
    ends with its parent."""
    root = Node("#root", None)
    open_, at, n = _Open(root), 0, len(source)
    while at < n:
        node = open_.stack[-1]
        m = _TOKEN.search(source, at)
        if not m:
            node.children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            node.children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                node.children.append(Node("br", node))
            elif tag != "p" or open_.has_paragraph():
                open_.close(tag)
            continue
        if tag in CLOSES_P and open_.has_paragraph():
            open_.close("p")
        if tag in CLOSES:
            open_.close_any(CLOSES[tag], SCOPE[tag])
        if tag == "body":  # an unclosed head ends here
            open_.close("head")
        node = open_.stack[-1]
        child = Node(tag, node, _mark(tag, m[3], bool(open_.at["article"] or open_.at["main"])))
        node.children.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and tag not in CLOSES_P and tag not in INLINE:
            continue
        open_.push(child)
    return root


def settle(root: Node) -> None:
    """Cut off what is marked as furniture, unless the page's text would go with it."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str) and not c.cut)
    plain: dict[Node, int] = {}  # characters outside of links and of what is marked and stays so
    whole: dict[Node, int] = {}  # the most that an article or main element below has
    for node in reversed(nodes):
        node.loose = sum(sum(map(len, c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if not isinstance(c, str) and not c.cut]
        plain[node] = 0 if node.tag == "a" or node.mark == FURNITURE else node.loose + sum(plain[c] for c in below)
        whole[node] = max([plain[node] if node.tag in ("article", "main") else 0, *(whole[c] for c in below)])
    outer, outside = [], plain[root]  # marked elements within no other

    def expose(top: Node) -> int:
        """Collect the outermost marked elements below; returns their characters."""
        found, stack = 0, [top]
        while stack:
            for c in stack.pop().children:
                if isinstance(c, str) or c.cut:
                    continue
                if c.mark:
                    outer.append(c)
                    found += plain[c]
                else:
                    stack.append(c)
        return found

    outside -= expose(root)
    while True:
        likely = [x for x in outer if x.mark == LIKELY]
        most = max(likely, key=lambda x: plain[x], default=None)
        if most is None or not plain[most]:
            break
        if not (outside < OUTSIDE * plain[most] or 2 * max(whole[x] for x in likely) > plain[root]):
            break
        if outside >= OUTSIDE * plain[most]:
            most = max(likely, key=lambda x: whole[x])
        outer.remove(most)
        most.mark = 0
        outside += plain[most] - expose(most)
    for x in outer:
        x.cut = True


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes that aren't cut off, in page order; text counts without white space."""
    settle(root)
    nodes, stack = [], [root]
    while stack:  # page order
        node = stack.pop()
        node.order = len(nodes)
        nodes.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.cut)
    for node in reversed(nodes):
        link = node.tag == "a"
        node.end = next((c.end for c in reversed(node.children) if not isinstance(c, str) and not c.cut), node.order + 1)
        node.chars = node.loose
        for c in node.children:
            if not isinstance(c, str) and not c.cut:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if link:
            node.link_chars = node.chars
    body = next((x for x in nodes if x.tag == "body"), root)
    chars, link_chars = max(1, body.chars), body.link_chars

    def density(c: int, tags: int, in_links: int, link_tags: int) -> float:
        """Characters per tag, by the logarithm of how few of them are in links, to a base that rises with links."""
        if not c:
            return 0.0
        t, lc, lt = max(1, tags), max(1, in_links), max(1, link_tags)
        base = math.log(c / max(1, c - in_links) * in_links + link_chars / chars * c + math.e)
        if base > 1 and c / lc * (t / lt) > 1:
            return c / t * math.log(c / lc * (t / lt)) / math.log(base)
        return c / t * (c != in_links) * 0.1

    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
    for node in nodes:
        # text of its own counts like a child with one tag
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and not c.cut)
        node.total += density(node.loose, 1, node.loose * (node.tag == "a"), 0)
    return nodes


def content(root: Node) -> list[Node]:
    """The roots of the main content, in page order: the densest sum and the branches that reach its threshold."""
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    below = nodes[body.order : body.end]
    best = max(below, key=lambda x: (x.total, -x.order))
    if not best.chars:
        return []
    path = [_block(best, body)]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    top: dict[int, Node] = {}  # of each subtree the node with the greatest sum
    for x in reversed(below):
        own = [top[c.order] for c in x.children if not isinstance(c, str) and not c.cut]
        top[x.order] = max([x, *own], key=lambda y: (y.total, -y.order))
    found: list[Node] = []
    for x in [y for y in below if y is not body and y.chars and y.density >= threshold] or [body]:
        at = top[x.order]
        found.append(_block(at, body))
    outer, end = [], -1
    for x in sorted({y.order: y for y in found}.values(), key=lambda y: y.order):
        if x.order >= end:
            outer.append(x)
            end = x.end
    # short lines (titles, captions) don't reach the threshold: the core, and an article or main element around it, is
    # content as a whole where the greater part of its text is found to be
    for whole in [x for x in path if x.tag in ("article", "main")] + [path[0]]:
        inside = [x for x in outer if whole.order <= x.order < whole.end]
        if whole is not body and 2 * sum(x.chars - x.link_chars for x in inside) > whole.chars - whole.link_chars:
            return sorted([whole, *(x for x in outer if not whole.order <= x.order < whole.end)], key=lambda x: x.order)
    return outer


def _block(node: Node, body: Node) -> Node:
    """The block that a row, an item or a paragraph is a part of: alone it is no content."""
    while node.tag in _PIECE and node is not body:
        node = node.parent
    while node.tag in _LINES and node is not body and node.parent is not body:
        node = node.parent
    return node


#: Parts of a block that don't stand alone, and those that do if the body itself is the block.
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
_PIECE = INLINE | frozenset("tr td th thead tbody tfoot li dt dd caption".split())


def text_of(roots: list[Node]) -> str:
    """White space in a block is one space, blocks are joined by one space."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(roots))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.cut:
            if x.tag not in INLINE:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def main_text(source: str | None) -> str:
    """The main text of a page; empty for null, empty or textless pages."""
    return text_of(content(parse(source))) if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages = batch.columns
        texts = [main_text(p.as_py()) for p in pages]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``; n_chars counts code points.

    Null and empty pages have an empty text; null ids and urls are kept, rows that repeat too; other columns are
    ignored; an empty table gives an empty table.
    """
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
