"""Main text of a web page by composite text density.

The page is read into a tree of block elements. Every node has its characters,
tags, characters within links and links; its composite density is the number of
characters per tag, lowered by a logarithm whose base grows with the share of
link text. The densities of a node's children are summed, the node with the
largest sum holds the article, and the smallest density on its path to the body
is the threshold: the same choice is repeated below every other node that is at
least as dense. Elements that cannot be part of an article (scripts, menus,
forms) and those whose class, id or role calls them something else are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from blockmill.llm.tables import text_of

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th wbr".split())
DROPPED = frozenset(
    "aside audio button canvas datalist footer form frame frameset head iframe input map math menu meter nav noframes "
    "noscript object optgroup option progress script select style svg template textarea title video dialog".split()
)
#: An opening tag of the key closes open elements of the value.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
}
#: Such a scope keeps the closing above from reaching further out.
SCOPES = frozenset("article body div dl html main ol section table ul".split())
#: Blocks nested deeper than this only end lines, as in browsers.
DEEPEST = 512
#: What may stand in a head; anything else ends one that was not closed.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Words of class, id and role that mark what is not the article.
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner sidebar sidebars "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices "
    "notification notifications alert alertdialog popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond "
    "widget widgets toolbar pagination pager search masthead complementary contentinfo hidden skip".split()
)
#: Words that make the next one a statement about the surroundings.
ABOUT = frozenset("has no not with without".split())
#: Elements that are never dropped for what they are called.
KEPT = frozenset("html body main".split())
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "depth", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "up")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up = tag, up
        self.depth = up.depth + 1 if up is not None else 0
        #: Text, nodes, and None where a line ends.
        self.parts: list[Node | str | None] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def _is_other(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in KEPT:
        return False
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            words = [w.lower() for w in _NAME_WORD.findall(value)]
            # "has-sidebar" speaks of another element.
            if any(w in OTHER_WORDS and before not in ABOUT for before, w in zip(["", *words], words, strict=False)):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


class _Reader(HTMLParser):
    """Builds the tree; never fails on broken markup."""

    def __init__(self, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name  # whether elements are dropped for what they are called
        self.dropped_by_name = False
        self.root = self.at = Node("html", None)
        self.skipped: list[str] = []  # open elements within a dropped one
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self._end_skipped(tag)
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in BLOCKS and tag not in ("html", "body"):
            self._end_paragraph()
        for old in CLOSES.get(tag, ()):
            self._close(old)
        dropped = tag in DROPPED or tag == "header" and not self._inside_article()
        if not dropped and self.by_name and _is_other(tag, attrs):
            dropped = self.dropped_by_name = True
        if dropped:
            if tag not in VOID:
                self.skipped.append(tag)
            if tag not in ("button", "input", "select"):
                self.at.parts.append(None)
            return
        if tag in BLOCKS or tag == "header":
            if tag in ("html", "body") and self.at.up is None and not any(isinstance(p, Node) for p in self.at.parts):
                self.root.tags += 1
                return
            if tag in VOID:
                self.at.tags += 1
                self.at.parts.append(None)
                return
            if self.at.depth >= DEEPEST:
                self.at.tags += 1
                self.at.parts.append(None)
                return
            node = Node(tag, self.at)
            node.tags = 1
            self.at.parts.append(node)
            self.at = node
            return
        self.at.tags += 1
        if tag in SPACES:
            self.at.parts.append(" ")
        if tag == "a":
            self.links = 1
            self.at.link_tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("path", "g", "circle"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
                return
            if tag not in BLOCKS or not self._is_open(tag):
                return
            self.skipped.clear()  # the end of an element around it ends a dropped one
        if tag == "a":
            self.links = 0
        elif tag in ("td", "th"):
            self.at.parts.append(" ")
        elif (tag in BLOCKS or tag == "header") and tag not in ("html", "body"):
            self._close(tag, anywhere=True)

    def handle_data(self, data):
        if self.skipped or not data:
            return
        size = len(data) - data.count(" ")
        self.at.parts.append(data)
        self.at.chars += size
        if self.links:
            self.at.link_chars += size

    def _end_skipped(self, tag: str) -> None:
        """End dropped elements that a starting ``tag`` closes, as their end tags may be left out."""
        if self.skipped == ["head"] and tag not in IN_HEAD:
            self.skipped.clear()
            return
        closed = CLOSES.get(tag, ()) + (("p",) if tag in BLOCKS else ())
        for n in range(len(self.skipped) - 1, -1, -1):
            if self.skipped[n] in closed:
                del self.skipped[n:]
                return
            if self.skipped[n] in BLOCKS or self.skipped[n] in DROPPED:
                return

    def _is_open(self, tag: str) -> bool:
        node = self.at
        while node.up is not None:
            if node.tag == tag:
                return True
            node = node.up
        return False

    def _inside_article(self) -> bool:
        node = self.at
        while node is not None:
            if node.tag in ("article", "main"):
                return True
            node = node.up
        return False

    def _end_paragraph(self):
        node = self.at
        while node.up is not None and node.tag not in SCOPES:
            if node.tag == "p":
                self.at = node.up
                return
            node = node.up

    def _close(self, tag: str, anywhere: bool = False):
        node = self.at
        while node.up is not None:
            if node.tag == tag:
                self.at = node.up
                return
            if not anywhere and node.tag in SCOPES:
                return
            node = node.up


def _wrap_loose_text(root: Node) -> None:
    """Text that stands beside blocks becomes a block of its own."""
    todo = [root]
    while todo:
        node = todo.pop()
        below = node.nodes()
        todo.extend(below)
        if not below or not node.chars:
            continue
        links, parts, run = node.link_chars / node.chars, [], None
        for part in node.parts:
            if isinstance(part, str):
                if run is None:
                    run = Node("#text", node)
                    run.tags = 1
                    parts.append(run)
                run.parts.append(part)
                run.chars += len(part) - part.count(" ")
                run.link_chars = round(links * run.chars)
            else:
                run = None
                parts.append(part)
        node.parts, node.chars, node.link_chars = parts, 0, 0


def _measure(root: Node) -> None:
    """Sums up the tree, then densities; iterative, as pages may be nested deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.nodes())
    for node in reversed(order):
        if node.up is not None:
            node.up.chars += node.chars
            node.up.tags += node.tags
            node.up.link_chars += node.link_chars
            node.up.link_tags += node.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        ratio = c / max(lc, 1) * t / max(lt, 1)
        # A base close to one would make the logarithm boundless.
        node.density = c / t * math.log(max(ratio, 1.0)) / max(math.log(max(base, 1.0)), 0.1) if c else 0.0
    for node in order:
        below = node.nodes()
        node.total = sum(x.density for x in below) if below else node.density


def _best(node: Node) -> Node:
    best, todo = node, [node]
    while todo:
        at = todo.pop()
        if at.total > best.total:
            best = at
        todo.extend(reversed(at.nodes()))
    return best


def _chosen(root: Node) -> set[int]:
    """The subtrees that make up the text, by identity."""
    best = _best(root)
    threshold, node = math.inf, best
    while node is not None:
        threshold = min(threshold, node.density)
        if node is root:
            break
        node = node.up
    chosen, todo = {id(best)}, [root]
    while todo:
        node = todo.pop()
        if id(node) in chosen:
            continue
        if node.density >= threshold and node is not root and node.density > 0 and not _holds(node, best):
            chosen.add(id(_best(node)))
        todo.extend(node.nodes())
    return chosen


def _holds(node: Node, inner: Node) -> bool:
    while inner is not None:
        if inner is node:
            return True
        inner = inner.up
    return False


def _article(root: Node) -> Node:
    """The page's only article or main element, if it has the densest block or half
    of the text, else its body: a teaser that is the only article is not the story."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.nodes()))
    densest = max((n for n in order if not n.nodes()), key=lambda n: n.density, default=root)
    for tag in ("article", "main"):
        found = [n for n in order if n.tag == tag and n.chars]
        found = [n for n in found if not any(_holds(o, n) for o in found if o is not n)]
        if len(found) == 1 and (_holds(found[0], densest) or 2 * found[0].chars >= root.chars):
            return found[0]
    return root


def main_text(html: str | None) -> str:
    """Article of a page: blocks in page order joined by a newline, white space
    within a block turned into one space. Null or empty: the empty text.

    Names of elements are no ground to drop all there is: a page of which nothing
    is left is read again without regard to them.
    """
    if not html:
        return ""
    last = html.rfind("<")
    if last >= 0 and html.find(">", last) < 0 and (html[last + 1 : last + 2].isalpha() or html[last + 1 : last + 2] == "/"):
        html = html[:last]  # a tag cut off by the end of the page
    reader = _Reader()
    reader.feed(html)
    reader.close()
    text = _text_of_tree(reader.root)
    if not text and reader.dropped_by_name:
        reader = _Reader(by_name=False)
        reader.feed(html)
        reader.close()
        text = _text_of_tree(reader.root)
    return text


def _text_of_tree(root: Node) -> str:
    _wrap_loose_text(root)
    _measure(root)
    top = _article(root)
    chosen = _chosen(top)
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    todo: list[tuple[Node | str | None, bool]] = [(top, False)]
    while todo:
        part, inside = todo.pop()
        if isinstance(part, Node):
            inside = inside or id(part) in chosen
            flush()
            todo.append((None, inside))
            todo.extend((p, inside) for p in reversed(part.parts))
        elif part is None:
            flush()
        elif inside:
            line.append(part)
    flush()
    return "\n".join(blocks)


@F.pandas_udf(StringType())
def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(h) for h in pages], dtype=object)


def main_texts(html: Column | str) -> Column:
    """Main text of a column of pages; null counts as an empty page. One row in,
    one row out; nothing is shuffled."""
    return _main_texts(text_of(html))
