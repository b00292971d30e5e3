"""Main text of web pages by composite text density (operator 2).

Every node of the parsed page gets the characters of its subtree per tag, lowered by the
share that stands in links. The node whose children have the largest sum of densities
holds the article; the smallest density on the path from there to the body is the
threshold that its neighbours must reach to count as well.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by how they are treated, and words in class or id by which page furniture is known.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head title script style noscript template iframe object embed svg canvas math audio video map nav footer aside button select "
    "option textarea input label fieldset dialog menu".split()
)
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("table ul ol dl div section article main body html blockquote td th aside nav header footer form".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup "
    "modal overlay newsletter subscribe subscription signup sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "comment comments commentlist reply replies respond disqus related recommended share sharing social widget login search pagination pager toolbar".split()
)
ARTICLE_NAMES = frozenset("article entry post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
KNOWN = VOID | BLOCK | DROPPED | INLINE | RAW
# a comment, a declaration, a tag with quoted attributes, or a tag whose quotes do not close
_MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CUT_TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)(?:[\s/][^<>]*)?|[/!?][^<>]*)?$")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "named", "titled")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.children = tag, parent, dropped, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.named = False  # its name is that of furniture; ``_settle`` judges by what it holds
        self.titled = False  # a heading of the first level below it would be the article's


def _furniture(tag: str, written: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """(dropped whatever it holds, named like furniture, a heading in it is the article's)."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True, False, False
    if not written or tag in ("html", "body", "main", "article"):
        return False, tag == "form", inside_article
    attrs = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(written)}
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True, False, False
    if (attrs.get("role") or "").lower() in ROLES:
        return True, False, False
    names = re.split(r"[^a-z]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())
    return False, tag == "form" or not FURNITURE.isdisjoint(names), inside_article or not ARTICLE_NAMES.isdisjoint(names)


class _Tree:
    """Builds nodes from markup, closing what HTML lets stay open."""

    def __init__(self):
        self.root = self.at = Node("html", None, False)
        self.articles = self.named = 0

    def feed(self, html: str) -> Node:
        at, size = 0, len(html)
        while at < size:
            found = _MARKUP.search(html, at)
            self.data(html[at : found.start() if found else size])
            if found is None:
                break
            at = found.end()
            if name := found[2] or found[4]:
                tag = name.lower()
                if found[1] or found[2] is None and found[0][1] == "/":
                    self.end(tag)
                else:
                    self.start(tag, found[3] if found[2] else found[5])
                    if tag in RAW:
                        close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                        self.data(html[at : close.start() if close else size])
                        at = close.end() if close else size
                        self.end(tag)
        if self.named:
            _settle(self.root)
        return self.root

    def data(self, text: str) -> None:
        if text and not self.at.dropped:
            self.at.children.append(unescape(text) if "&" in text else text)

    def _close(self, tag: str) -> None:
        node = self.at
        while node.tag != tag:
            node = node.parent
        while True:
            done, self.at = self.at, self.at.parent or self.root
            self.articles -= done.tag in ("article", "main")
            if done is node:
                return

    def _open(self, names, fences=FENCES) -> str | None:
        """The nearest open element of those names, not looking behind a fence."""
        node = self.at
        while node.parent is not None:
            if node.tag in names:
                return node.tag
            if node.tag in fences:
                return None
            node = node.parent
        return None

    def start(self, tag: str, attrs: str) -> None:
        if tag == "html" or (tag == "body" and self._open({"body"}, ())):
            return
        if tag in ENDS_P and self._open({"p"}):
            self._close("p")
        if tag in SIBLINGS and (open_one := self._open(SIBLINGS[tag], FENCES - {"td", "th"} if tag == "tr" else FENCES - SIBLINGS[tag])):
            self._close(open_one)
        if tag == "body" and self._open({"head"}, ()):
            self._close("head")
        dropped, named, titled = _furniture(tag, attrs, self.articles > 0)
        node = Node(tag, self.at, self.at.dropped or dropped)
        node.named, node.titled = named, titled
        self.named += named
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.articles += tag in ("article", "main")
            if attrs.endswith("/") and tag in ("svg", "path", "use", "g", "rect", "circle"):
                self._close(tag)

    def end(self, tag: str) -> None:
        if tag != "html" and tag not in VOID and self._open({tag}, () if tag in FENCES else FENCES):
            self._close(tag)


def _settle(root: Node) -> None:
    """Drop what is named like furniture, but for what holds the page's text or the article's heading.

    The first is a wrapper such as one with a sidebar in it: more than half of the
    page's characters outside links. As an advert may be longer than a short article, it also
    holds two paragraphs or an article element, if there is one on the page. What is named so
    in a wrapper is judged by itself.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    plain, headed, paragraphs, articles = {}, {}, {}, {}
    for node in reversed(order):
        inside = [c for c in node.children if isinstance(c, Node) and id(c) in plain]
        text = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        plain[id(node)] = 0 if node.tag == "a" else text + sum(plain[id(c)] for c in inside)
        paragraphs[id(node)] = (node.tag == "p") + sum(paragraphs[id(c)] for c in inside)
        articles[id(node)] = (node.tag in ("article", "main")) + sum(articles[id(c)] for c in inside)
        headed[id(node)] = node.tag == "h1" or any(headed[id(c)] for c in inside)
    for node in order:  # outer ones first
        i = id(node)
        wrapper = 2 * plain[i] > plain[id(root)] and (paragraphs[i] > 1 or articles[i] > 0 or not articles[id(root)])
        if (node.parent is not None and node.parent.dropped) or (node.named and not wrapper and not (node.titled and headed[i])):
            node.dropped = True


def _measure(root: Node) -> list[Node]:
    """Fill in the sums of every node; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / lc * t / lt) * math.e) / math.log(base + math.e)
        if node.parent is not None:
            node.parent.total += node.density
    return order


def content_roots(root: Node) -> list[Node]:
    """The subtrees that make up the article, in page order."""
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    inside, stack = [], [body]
    while stack:
        node = stack.pop()
        inside.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    best = max(inside, key=lambda n: n.total)
    if not best.total:
        return [body]
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    for node in reversed(path):
        if node.tag in ("article", "main") and node.density > 0:
            return [node]
    limit = min(n.density for n in path)
    roots, on_path = [], set(map(id, path))

    def gather(node: Node) -> None:
        for c in node.children:
            if isinstance(c, Node) and not c.dropped:
                if c is best:
                    roots.append(c)
                elif id(c) in on_path:
                    gather(c)
                elif c.density >= limit or c.tag in ("h1", "h2"):
                    roots.append(c)

    if best is body:
        return [body]
    gather(body)
    return roots


def block_texts(roots: list[Node]) -> list[str]:
    """Texts of the blocks under the roots: white space as one space, empty blocks left out."""
    out, held = [], []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    for root in roots:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                held.append(x)
            elif x is None:
                flush()
            elif not x.dropped:
                if x.tag == "br":
                    held.append(" ")
                elif x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.children)
        flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page as lines; empty for an empty page."""
    if not html:
        return ""
    cut = _CUT_TAG.search(html)
    if cut and (cut[1] is None or _starts_tag(cut[1].lower(), cut.end(1) == len(html))):
        html = html[: cut.start()]
    return "\n".join(block_texts(content_roots(_Tree().feed(html))))


def _starts_tag(name: str, ends_here: bool) -> bool:
    """Whether HTML knows an element of that name, or, where the page ends within the name, one that begins so."""
    return any(known.startswith(name) if ends_here else known == name for known in KNOWN)


def _texts(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page; one pass without a shuffle.

    The text has one line per block, without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments. A null or empty page has an empty text; a
    page cut off in the middle of a tag ends before it; unclosed elements are closed as HTML
    says; nothing is cut by length. Repeated rows are treated each, other columns are not
    read, an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string")
