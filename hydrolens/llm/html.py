"""Main text of web pages by tree scoring.

A page becomes a tree of blocks. Elements whose class, id or role names page furniture are taken out, unless they hold the page's main article, or bear the word
only within a longer name (``market-share``) and hold a good part of the paragraphs. Every paragraph gives points for its length and its commas to its parent and half
of them to its grandparent; the points of a container shrink with the share of its text that stands in links. Where the best container lies in an ``article`` or ``main``,
all of that is kept; elsewhere its siblings that score well or read like paragraphs are kept with it. The blocks are joined in page order.

Defined cases: null or empty html and pages without text give an empty string; unclosed tags, unknown references and truncated
pages are read as far as they go; repeated rows are each extracted; nothing is cut at any length; an empty table gives an empty table.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of, unpacked

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas nav footer aside form button select textarea head title dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
CLOSES_P = BLOCKS - {"html", "body"}
#: Words in class or id that mark page furniture or reader comments.
FURNITURE = re.compile(r"(?i)(?<![a-z])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|disqus|footer|menu|nav\w*|newsletter|notice|pager|popup|promo\w*|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?![a-z])")
COMMENTS = re.compile(r"(?i)(?<![a-z])(comments?|disqus|respond)(?![a-z])")
SPACE = re.compile(r"\s+")
ARTICLE = ("article", "main")
#: Share of the page's paragraph points from which an element is text although its longer name holds a furniture word.
TEXT_SHARE = 0.2


def furniture(mark: str) -> int:
    """2 if a name says furniture, 1 if furniture words stand only within longer names, else 0."""
    found = [(word, m) for word in mark.split() for m in FURNITURE.finditer(word)]
    if any(m[0] == word or COMMENTS.search(word) for word, m in found):
        return 2
    return 1 if found else 0


class Node:
    __slots__ = ("tag", "parent", "children", "score", "sums", "mark", "points")

    def __init__(self, tag, parent, mark=0):
        self.tag, self.parent, self.children, self.score, self.sums, self.mark, self.points = tag, parent, [], 0.0, None, mark, 0.0


class Tree(HTMLParser):
    """Builds the tree without the parts that are never main text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None)
        self.skip: list[str] = []
        self.open: Counter[str] = Counter()

    def parse_comment(self, i, report=1):
        """A comment without an end reaches to the end of the page, as in browsers; the whole page is fed at once."""
        if self.rawdata.startswith(("<!-->", "<!--->"), i):
            return self.rawdata.index(">", i) + 1
        at = self.rawdata.find("-->", i + 4)
        return len(self.rawdata) if at < 0 else at + 3

    def parse_marked_section(self, i, report=1):
        """Marked sections outside of XML are comments up to the next ``>``."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in CLOSES_P:
            self._close("p", BLOCKS - {"p"})
        if tag == "li":
            self._close("li", {"ul", "ol"})
        if tag in VOID:
            self.at.children.append(Node(tag, self.at))
            return
        values = dict(attrs)
        mark = f"{values.get('class') or ''} {values.get('id') or ''} {values.get('role') or ''}"
        header = tag == "header" and not self.open["article"]
        if tag in DROPPED or header or "hidden" in values or values.get("aria-hidden") == "true":
            self.skip = [tag]
            return
        node = Node(tag, self.at, 0 if tag in ("html", "body", *ARTICLE) else furniture(mark))
        self.at.children.append(node)
        self.open[tag] += 1
        self.at = node

    def handle_startendtag(self, tag, attrs):
        if not self.skip and tag in VOID:
            self.at.children.append(Node(tag, self.at))
        elif not self.skip:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            elif tag in ("body", "html"):
                self.skip = []
            return
        self._close(tag, BLOCKS if tag not in BLOCKS else frozenset())

    def handle_data(self, data):
        if not self.skip:
            self.at.children.append(data)

    def _close(self, tag, stop):
        """Close the nearest open ``tag``, unless an element of ``stop`` stands in between."""
        if not self.open[tag]:
            return
        node = self.at
        while node.parent and node.tag != tag and node.tag not in stop:
            node = node.parent
        if node.parent and node.tag == tag:
            while self.at is not node.parent:
                self.open[self.at.tag] -= 1
                self.at = self.at.parent


def order(root: Node) -> list[Node]:
    """All nodes, parents first; without recursion, so that depth is no limit."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def measure(nodes: list[Node]) -> None:
    """Characters, characters in links and commas below each node, children first."""
    for node in reversed(nodes):
        size = links = commas = 0
        for c in node.children:
            if isinstance(c, str):
                size, commas = size + len(c), commas + c.count(",")
            else:
                size, links, commas = size + c.sums[0], links + c.sums[1], commas + c.sums[2]
        node.sums = (size, size if node.tag == "a" else links, commas)


def density(node: Node) -> float:
    return node.sums[1] / node.sums[0] if node.sums[0] else 0.0


def points_of(node: Node) -> float:
    """What a paragraph gives: one point, one for each comma, one for each hundred characters up to three."""
    return 1 + node.sums[2] + min(node.sums[0] / 100, 3) if node.tag in PARAGRAPHS and node.sums[0] else 0.0


def without_furniture(root: Node) -> None:
    """Take marked elements out of the tree, except those that hold the main article or much of the text."""
    nodes = order(root)
    marked = [n for n in nodes if n.mark]
    if not marked:
        return
    measure(nodes)
    below = set()
    for n in nodes:
        if n.mark or id(n.parent) in below:
            below.add(id(n))
    for n in reversed(nodes):
        n.points += points_of(n) * (1 - density(n))
        if n.parent is not None:
            n.parent.points += n.points
    # the main article: the one with most text among those outside of furniture, else among all
    articles = [n for n in nodes if n.tag in ARTICLE and n.points]
    clear = [n for n in articles if id(n) not in below]
    holders, at = set(), max(clear or articles, key=lambda n: n.points, default=None)
    while at is not None:
        holders.add(id(at))
        at = at.parent
    dropped = {id(n) for n in marked if id(n) not in holders and not (n.mark == 1 and n.points >= TEXT_SHARE * root.points and density(n) < 0.5)}
    for parent in {id(n.parent): n.parent for n in marked}.values():
        parent.children = [c for c in parent.children if id(c) not in dropped]


def best_parts(root: Node) -> list[Node]:
    without_furniture(root)
    nodes = order(root)
    measure(nodes)
    scored: dict[int, Node] = {}
    for node in nodes:
        points = points_of(node)
        if points and node.parent:
            for up, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
                if up is not None:
                    up.score += points * share
                    scored[id(up)] = up
    if not scored:
        return [root]
    final = {k: n.score * (1 - density(n)) for k, n in scored.items()}
    top = scored[max(final, key=final.get)]
    while top.parent is not None and top.tag in BLOCKS and top.tag in ("p", "li", "ul", "ol", "td", "tr", "tbody", "table", "blockquote"):
        top = top.parent
    around = top
    while around is not None and around.tag not in ARTICLE:
        around = around.parent
    if around is not None:
        return [around]
    if top.parent is None:
        return [top]
    bar = max(10.0, 0.2 * final.get(id(top), 0))
    kept = []
    for c in top.parent.children:
        if c is top:
            kept.append(c)
        elif isinstance(c, Node) and (final.get(id(c), 0) >= bar or c.tag == "p" and c.sums[0] > 80 and density(c) < 0.25):
            kept.append(c)
    return kept


def blocks(parts: list[Node]) -> list[str]:
    out, run = [], []

    def flush():
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack = list(reversed(parts))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        else:
            block = x.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(blocks(best_parts(tree.root)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row with ``text`` and ``n_chars``."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch])

    out = packed(pages, __html=text_of(html)).withColumn("text", texts("__html"))
    return unpacked(out.withColumn("n_chars", F.length("text").cast("long")), "text", "n_chars")
