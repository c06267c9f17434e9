"""Main text of web pages by composite text density.

The page becomes a DOM tree. For a node with C characters, T tags, LC characters and LT tags inside links, and the
body's ratio of link characters r, the composite density is
C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + r * C + e)), zero counts being one: characters per tag,
lowered by links. The density sum of a node adds its children's densities; the node with the largest sum is the main
subtree. The least density on its path from the body is the threshold for what stands beside that path at every level:
nodes at or above it belong to the text too, and so does bare text. An article or main element around the subtree is
the subtree, and so is the one below it, if there is one only and it holds a third of the characters. All densities are taken again without what goes anyway, and the largest sum and the threshold are found in
what is left. Beside the path, blocks without links that are plain text elements, or of the same element as the path,
belong to the text too: the formula alone would take a short closing section for thin.

What goes: scripts, styles, menus, headers, footers, sidebars, forms and hidden elements by element and role; elements
with a class or id that is one of the words below (a whole one: "sidebar", not "with-sidebar"); blocks that are mostly
links, in an article only if they have less than LINK_DENSITY characters a tag, as menus do and references don't. A word
that is a part of a class ("cookie-notice", "share-buttons") counts only where density calls the block thin as well: in
an article if it is mostly links, elsewhere also if its density is below the threshold. Words don't count for an element
that wraps an article or most of the page's text. Density can't tell a dense advert or a long comment from the article,
so those go by element or whole word only; thin lists of at least three entries that begin with two or more inline
elements and hold no heading (a name and a date, as reader comments do) go without one. A line of copyright outside an
article goes. Blocks keep page order, white space in a block is one space, blocks are joined by an empty line; character
references are decoded; nothing else is dropped.

Null html counts as empty and gives an empty text; text without tags is one block. Unclosed, misnested and cut-off
markup is accepted: a quote without its pair ends with its tag, and a tag without an end is text. Elements deeper than
DEPTH join the level above. Work is linear in the page. Repeated rows stay; an empty table gives none. Columns other
than page_id, url, html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_limits

SCHEMA = "page_id long, url string, text string, n_chars long"
#: A quote counts after an equals sign, if its pair follows. The last group is empty for a tag that the page cuts off.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>?)", re.S)
DEPTH = 200
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|aria-modal)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
OUT = frozenset("nav aside footer form button select script style noscript template iframe svg canvas object dialog head title textarea menu datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related recommended "
    "newsletter subscribe subscription signup login search toolbar pagination pager widget skip tags "
    "werbung anzeige anzeigen seitenleiste navigationsleiste fusszeile fussleiste kopfzeile hinweis kommentar kommentare "
    "publicite annonce pied entete avis commentaire commentaires publicidad anuncio anuncios pie cabecera barra aviso comentario comentarios".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters a tag of a menu at most: ten for a link in a list item.
LINK_DENSITY = 5
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)\s*\d{4}|copyright\s*(?:©|\(c\)|\d{4}))", re.I)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol table figure".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("attributes", "chars", "children", "density", "depth", "links", "link_chars", "names", "on_path", "parent", "tag", "tags", "total", "wraps")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.attributes, self.children = tag, parent, attributes, []
        self.depth = parent.depth + 1 if parent else 0
        self.on_path = False
        above = parent.names if parent else frozenset()  # of the elements from the root to here
        self.names = above if tag in above else above | {tag}


def parse(page: str) -> Node:
    root = top = Node("#root", None)
    at, n = 0, len(page)

    def put(text: str) -> None:
        if text:
            top.children.append(entities.unescape(text) if "&" in text else text)

    for m in iter(lambda: TAG.search(page, at), None):
        put(page[at : m.start()])
        if m[2] and not m[4]:  # no end anywhere: text
            at = m.start()
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = top if tag in top.names else root
            while node is not root and node.tag != tag:
                if node.tag in ("table", "body") and tag not in ("body", "html"):
                    node = root  # an end tag does not reach out of a table
                    break
                node = node.parent
            if node is not root:
                top = node.parent
            continue
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            node = root if top.names.isdisjoint(closed.split()) else top
            while node is not root and node.tag not in until.split():
                if node.tag in closed.split():
                    top = node.parent
                node = node.parent
        if tag in BLOCK:  # a block ends an open paragraph
            node = top if "p" in top.names else root
            while node is not root and node.tag not in ("table", "td", "button", "article", "section", "div", "body"):
                if node.tag == "p":
                    top = node.parent
                    break
                node = node.parent
        node = Node(tag, top, m[3])
        top.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif top.depth < DEPTH:
            top = node
    put(page[at:])
    return root


def left_out(node: Node, in_article: bool) -> bool:
    """By element, role, or a whole class or id."""
    if node.tag in OUT or node.tag == "header" and not in_article:
        return True
    if not node.attributes or node.tag in ("body", "html", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in OUT_ROLES:
            return True
        if name in ("class", "id") and not node.wraps:
            words = set(value.lower().split())
            if words & OUT_WORDS or "header" in words and not in_article:
                return True
    return False


def hinted(node: Node, in_article: bool) -> bool:
    """Whether a part of a class or id is one of the words, which alone proves nothing."""
    if not node.attributes or node.wraps or node.tag in ("body", "html", "article", "main"):
        return False
    parts = {w.lower() for name, value in ATTRIBUTE.findall(node.attributes) if name.lower() in ("class", "id") for w in WORDS.findall(value)}
    return bool(parts & OUT_WORDS) or "header" in parts and not in_article


def measured(root: Node) -> Node:
    """Counts, densities and density sums of every node, children first; the body."""
    order, stack, body = [], [root], root
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "body" and body is root:
            body = node
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        node.chars = node.tags = node.links = node.link_chars = 0
        node.wraps = any(isinstance(c, Node) and (c.wraps or c.tag in ("article", "main")) for c in node.children)
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) - c.count(" ")
            elif c.tag not in RAW:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.links += c.links + (c.tag == "a")
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
        if node.tag == "a":
            node.link_chars = node.chars
    ratio = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.links)
        base = math.log(math.log(c / max(1, c - node.link_chars) * node.link_chars + ratio * c + math.e) + 1e-9) if c else 0
        node.density = c / t * math.log(max(1.0, c / lc * t / lt)) / max(base, 1e-2) if c else 0.0
        node.wraps = node.wraps or 2 * node.chars > body.chars and 2 * node.link_chars < node.chars
        node.total = sum(x.density for x in node.children if isinstance(x, Node))
    return body


def records(node: Node) -> bool:
    """Whether the node is a list of entries that each begin with inline elements, as comments with a name and a date do."""
    blocks = [x for x in node.children if isinstance(x, Node) and x.tag in BLOCK]
    entries = [x for x in blocks if x.tag in ("div", "li") and opens_inline(x)]
    return len(entries) >= 3 and 2 * len(entries) >= len(blocks)


def opens_inline(entry: Node) -> bool:
    inner = [x for x in entry.children if isinstance(x, Node)]
    first = next((i for i, x in enumerate(inner) if x.tag in BLOCK), len(inner))
    return first >= 2 and first < len(inner) and not any(x.tag in HEADINGS for x in inner)


def linked(node: Node, inside: bool) -> bool:
    """Whether a block off the path is mostly links; in an article, whether it is a menu."""
    if node.tag not in BLOCK or node.on_path or node.links < 3 or 2 * node.link_chars <= node.chars:
        return False
    return node.tag != "p" and node.chars < LINK_DENSITY * node.tags if inside else True


def thin(node: Node, inside: bool, threshold: float) -> bool:
    """Whether a block off the path goes for its density: menus, thin lists of records, and what a part of its class names as well."""
    if node.on_path or node.tag not in BLOCK:
        return False
    if linked(node, inside) or node.density < threshold and node.tag not in PLAIN and records(node):
        return True
    return hinted(node, inside) and (node.links >= 2 and 2 * node.link_chars > node.chars or not inside and node.density < threshold)


def prune(body: Node, goes) -> None:
    """Take out the nodes that go, so that they don't dilute the densities of the rest."""
    stack = [(body, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [x for x in node.children if isinstance(x, str) or not goes(x, inside)]
        stack += [(x, inside) for x in node.children if isinstance(x, Node)]


def blocks_of(nodes: list[Node], in_article: bool, threshold: float = 0.0) -> list[str]:
    out: list[list[str]] = [[]]
    stack: list = [(x, in_article) for x in reversed(nodes)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        elif item.tag == "br":
            out[-1].append(" ")
        elif not thin(item, inside, threshold):
            inside = inside or item.tag in ("article", "main")
            if item.tag in BLOCK:
                out.append([])
                stack.append((None, inside))
            stack += [(x, inside) for x in reversed(item.children)]
    texts = [t for t in (" ".join("".join(b).split()) for b in out) if t]
    while not in_article and len(texts) > 1 and len(texts[-1]) < 200 and COPYRIGHT.match(texts[-1]):
        texts.pop()
    return texts


def densest(body: Node) -> list[Node]:
    """The path from the node of the largest density sum up to the body, marked."""
    best, stack = None, [body]
    while stack:
        node = stack.pop()
        node.on_path = False
        if node.chars and (best is None or node.total > best.total):
            best = node
        stack += [x for x in node.children if isinstance(x, Node)]
    path, node = [], best
    while node is not None:
        path.append(node)
        node.on_path = True
        node = None if node is body else node.parent or body
    return path


def lone_article(node: Node) -> list[Node]:
    """The one article or main element below the node, if it holds a third of its characters or more."""
    found, stack = [], [node]
    while stack:
        below = stack.pop()
        if below.tag in ("article", "main"):
            found.append(below)
        else:
            stack += [x for x in below.children if isinstance(x, Node)]
    return found if len(found) == 1 and 3 * found[0].chars >= node.chars else []


def main_text(page: str | None) -> str:
    root = parse(page or "")
    body = measured(root)
    prune(body, left_out)
    measured(root)
    if not densest(body):
        return ""
    prune(body, linked)
    measured(root)
    path = densest(body)
    if not path:
        return ""
    threshold = min(x.density for x in path)
    around = [x for x in path if x.tag in ("article", "main")] or lone_article(path[0])
    chosen: deque = deque(around[-1:] or path[:1])
    if around or path[0] is body:
        path = []
    for inner, outer in zip(path, path[1:], strict=False):
        at = next(i for i, x in enumerate(outer.children) if x is inner)
        edge = [None] if inner.tag in BLOCK else []
        chosen.extendleft(reversed(beside(outer.children[:at], threshold, inner.tag) + edge))
        chosen.extend(edge + beside(outer.children[at + 1 :], threshold, inner.tag))
    return "\n\n".join(blocks_of(list(chosen), bool(around), threshold))


def beside(nodes: list, threshold: float, like: str) -> list:
    """What belongs to the text of the nodes beside the path, whose node here is an element `like`.

    Blocks dense enough, blocks without links that are text elements or `like`, and bare text with its inline elements
    unless links prevail.
    """
    plain = lambda x: not x.link_chars and x.chars and (x.tag in PLAIN or x.tag == like)
    out: list = []
    for inline, group in groupby(nodes, lambda x: isinstance(x, str) or x.tag not in BLOCK):
        run = list(group)
        if inline:
            chars = sum(len(x) - x.count(" ") if isinstance(x, str) else x.chars for x in run)
            links = sum(x.link_chars for x in run if isinstance(x, Node))
            if 2 * links <= chars:
                out += run
                continue
        out += [x for x in run if isinstance(x, Node) and (plain(x) or x.density >= threshold and x.density > 0 and (x.total >= threshold or x.tag in PLAIN))]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    arrow_limits(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(run, SCHEMA)
