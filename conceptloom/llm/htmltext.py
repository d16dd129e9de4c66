"""Main text of HTML pages by minimum cut.

A page is cut into text blocks. A small classifier gives each block log-odds of being content, within about -7 and 3, from
its own text and the marked elements around it; these become capacities to the two terminals. Blocks next to each other, and blocks that follow each other under one
element, are joined by edges whose capacity falls with their distance in the document tree. The minimum cut is the
cheapest labelling of all blocks together.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Elements whose content is never text of the page, elements without content, and elements that start a new block.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option datalist textarea head title button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("title style script meta link base noscript template".split())
#: Elements that end an open p; elements that end an open one of the same kind.
ENDS_P = BLOCKS - {"br", "html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Costs, in log-odds, that an element around a block adds for keeping (below 0: for dropping) the block.
ELEMENT_COST = {"nav": -4.2, "footer": -4.2, "aside": -4.2, "form": -4.2, "menu": -4.2, "dialog": -4.2, "header": -2.1, "fieldset": -1.4, "address": -1.0, "article": 1.0, "main": 0.7}
#: Words of class, id and role that mark what is not the article, and what is; words that make a name a state of a layout.
NOT_ARTICLE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|respond|replies|reply|disqus|discussion|feedback|reviews|share|sharing|social|related|recommend\w*|widget|tags?|meta|byline|copyright|legal|disclaimer|search|skip|complementary|contentinfo|form|aside|teaser|trending|popular|more|outbrain|taboola"
)
ARTICLE = re.compile(r"article|content|main|post|entry|story|body|text|hentry|articlebody")
STATES = frozenset("has no with without is open opened closed page layout wrap wrapper container enabled active ready".split())
#: Elements whose items are weighed together while they are short; the longest text of an item of such a list.
GROUPS, ITEM = frozenset("ul ol dl table".split()), 200
#: A block of this many characters is prose. Shares of a page's prose, with an article in it and with an h1 as well, from which on an element outvotes its own name.
PROSE, OUTVOTES, OUTVOTES_WITH_H1 = 40, 0.9, 0.5
#: Least log-odds of blocks of an article, and of main, that nothing is held against: length and links alone do not drop them.
FLOOR = {"article": 0.5, "main": 0.2}
#: Log-odds of such words, of a link's share of a block, of length, of sentence marks, of headings, and of a block as such;
#: bounds of what all elements around a block add; capacity of an edge between blocks of one element.
MARK_NOT, MARK_YES, LINKS, LENGTH, SENTENCE, HEADING, BIAS, MARKS, SMOOTH = -4.2, 0.5, -3.0, 0.5, 0.5, 0.3, -1.7, (-4.5, 1.5), 2.4

#: A comment ends as browsers end it, at once even; what else starts with ! or ? ends at the next >.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
WHITE = re.compile(r"[\s ]+")


#: Elements that an end tag of an inline or list element does not close; elements that li, td and the like do not reach over.
CONTAINERS = frozenset("article main nav footer aside form header section table td th div".split())
LISTS = frozenset("ul ol dl table div section article nav menu".split())


class Node:
    """An open element. What its ancestors decide is carried down, so that no question about it walks to the root."""

    __slots__ = ("tag", "up", "depth", "silent", "inside", "cost", "named", "against", "for_", "block", "container", "list_", "group", "prose", "h1", "article")

    def __init__(self, tag: str, up: Node | None, cost: float, named: float, silent: bool, inside: str):
        self.tag, self.up, self.silent, self.inside = tag, up, silent, inside
        self.depth = up.depth + 1 if up else 0
        self.cost, self.named = cost, named
        self.prose, self.h1, self.article = 0, tag == "h1", tag in FLOOR
        self.group = self if tag in GROUPS else up.group if up else None
        self.block = self if up is None or tag in BLOCKS else up.block
        self.container = self if up is None or tag in CONTAINERS else up.container
        self.list_ = self if up is None or tag in LISTS or tag in SAME else up.list_


    def weigh(self) -> None:
        """Costs of the element and those around it, which are weighed already."""
        up = self.up
        cost = self.cost + self.named
        # what is marked off gains nothing from what is around it
        self.against = (up.against if up else 0.0) + min(cost, 0.0)
        self.for_ = 0.0 if cost <= ELEMENT_COST["header"] else (up.for_ if up else 0.0) + max(cost, 0.0)


@dataclass
class Block:
    text: str
    node: Node
    linked: float
    heading: bool


def tree_distance(a: Node, b: Node) -> int:
    """Steps between two elements of the tree; over all neighbours of a page no more than its tags."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def _named(names: str, inside: bool) -> float:
    """Cost of an element's names. Of names for and against none counts; an article may have a header.

    A name is read by its parts: cookie-banner is a banner, but has-sidebar and menu-open are states of a layout.
    """
    against = yes = False
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not STATES.isdisjoint(parts):
            continue
        if any(NOT_ARTICLE.fullmatch(x) for x in parts) and not (inside and ("header" in parts or "masthead" in parts)):
            against = True
        elif any(ARTICLE.fullmatch(x) for x in parts):
            yes = True
    return 0.0 if against and yes else MARK_NOT if against else MARK_YES if yes else 0.0


def _enter(tag: str, attributes: str, up: Node) -> Node:
    inside = tag if tag in FLOOR and up.inside != "article" else up.inside
    cost, named = ELEMENT_COST.get(tag, 0.0), 0.0
    if tag == "header" and up.inside:
        cost = 0.0  # the heading of the article itself
    silent = up.silent or tag in SILENT
    if attributes:
        names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower().replace("_", "-")
        if names and tag not in ("html", "body", "article", "main"):
            named = _named(names, bool(up.inside))
        silent = silent or bool(HIDDEN.search(attributes))
    return Node(tag, up, cost, named, silent, inside)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, in time linear in the page. Unclosed, crossed and unknown elements are mended much as browsers do."""
    root = Node("", None, 0.0, 0.0, False, "")
    node, out, parts, nodes = root, [], [], [root]
    open_: dict[str, list[Node]] = {}
    linked = total = 0
    in_link = heading = False

    def end() -> None:
        nonlocal parts, linked, total, heading
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, node, linked / max(1, total), heading))
        parts, linked, total, heading = [], 0, 0, False

    def add(raw: str) -> None:
        nonlocal linked, total, heading
        if raw and not node.silent:
            parts.append(raw)
            n = len(raw.strip())
            total += n
            linked += n * in_link
            heading = heading or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    def close(last: Node) -> None:
        """Ends last and all that is open within it."""
        nonlocal node
        while node is not last.up:
            open_[node.tag].pop()
            node = node.up

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if page.startswith("<![CDATA[", m.start()) and (open_.get("svg") or open_.get("math")):
                at = (page.find("]]>", m.start()) + 1 or n + 1) + 2  # a section of its own in drawings only
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end()
        if m[1]:
            if found := open_.get(tag):
                # an end tag of an inline or list element does not close the container around
                if tag in BLOCKS or found[-1].depth >= node.container.depth:
                    close(found[-1])
            if tag == "a":
                in_link = False
            continue
        if (tag not in HEAD and not node.silent or tag in BLOCKS or tag == "body") and open_.get("head"):
            close(open_["head"][-1])  # the head ends where the body starts, tags or not
        if tag in ENDS_P and node.block.tag == "p":
            close(node.block)
        if tag in SAME:
            k = node.list_
            while k.up is not None and k.tag not in SAME[tag] and k.tag not in LISTS:
                k = k.up.list_
            if k.tag in SAME[tag]:
                close(k)
                if tag == "tr" and node.tag == "tr":
                    close(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        node = _enter(tag, m[3], node)
        nodes.append(node)
        open_.setdefault(tag, []).append(node)
        if tag == "a":
            in_link = True
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = shut.end() if shut else n
            close(node)
    end()
    _weigh_all(nodes, out)
    return out


def _weigh_all(nodes: list[Node], bs: list[Block]) -> None:
    """Costs of all elements. One that holds most of the page's prose is no menu or form, whatever it is called."""
    for b in bs:
        b.node.prose += len(b.text) * (len(b.text) >= PROSE and b.linked < 0.5)
    for k in reversed(nodes):
        if k.up is not None:
            k.up.prose += k.prose
            k.up.h1 |= k.h1
            k.up.article |= k.article
    all_ = nodes[0].prose
    for k in nodes:
        if all_ and (k.h1 or k.article) and k.prose >= all_ * (OUTVOTES_WITH_H1 if k.h1 else OUTVOTES):
            k.named = max(k.named, 0.0)
            if k.tag in ("form", "fieldset"):
                k.cost = 0.0
        k.weigh()


def unary(b: Block) -> float:
    """The log-odds that the block is content, by its own text and the elements around it."""
    return _odds(b, len(b.text), b.linked, sum(b.text.count(c) for c in ".!?;:"), BIAS)


def _odds(b: Block, length: int, linked: float, marks: int, bias: float) -> float:
    text = LINKS * linked + LENGTH * min(6.0, length**0.5 / 3) + SENTENCE * min(2, marks) + HEADING * b.heading
    odds = bias + text + max(MARKS[0], min(MARKS[1], b.node.against + b.node.for_))
    return max(odds, FLOOR[b.node.inside]) if b.node.inside and b.node.against == 0 else odds


def costs(bs: list[Block]) -> list[float]:
    """unary() of each block; short items of one list or table, but for lists of links, share the odds of their list in equal parts."""
    out = [unary(b) for b in bs]
    lists: dict[int, list[int]] = {}
    for i, b in enumerate(bs):
        if b.node.group is not None:
            lists.setdefault(id(b.node.group), []).append(i)
    for items in lists.values():
        if len(items) > 1 and all(len(bs[i].text) <= ITEM for i in items):
            length = sum(len(bs[i].text) for i in items)
            linked = sum(bs[i].linked * len(bs[i].text) for i in items) / length
            marks = sum(bs[i].text.count(c) for i in items for c in ".!?;:")
            if linked >= 0.5:
                continue  # a menu is a menu item by item
            for i in items:
                odds = _odds(bs[i], length, linked, marks, BIAS)
                # what marks around the items add is each item's own
                own = max(MARKS[0], min(MARKS[1], bs[i].node.against + bs[i].node.for_))
                out[i] = odds if bs[i].node.inside and bs[i].node.against == 0 else (odds - own) / len(items) + own
    return out


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and blocks that follow each other under one parent, with capacities.

    A capacity falls with the distance in the tree, and is a quarter where the marked elements around differ.
    """
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def joined(i: int, j: int, c: float) -> None:
        a, b = bs[i].node, bs[j].node
        out[i, j] = out.get((i, j), 0.0) + (c if (a.against, a.for_) == (b.against, b.for_) else c / 4)

    for i, b in enumerate(bs):
        if i:
            # items of one list or table stay together
            same = b.node.group is not None and b.node.group is bs[i - 1].node.group
            joined(i - 1, i, SMOOTH if same else SMOOTH / (1 + tree_distance(bs[i - 1].node, b.node)))
        parent = id(b.node.up or b.node)
        if (j := last.get(parent)) is not None and j != i - 1:
            joined(j, i, SMOOTH / 3)
        last[parent] = i
    return [(i, j, c) for (i, j), c in out.items()]


def min_cut(costs: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: keep) of least cost: dropping i costs max(0, costs[i]), keeping it max(0, -costs[i]), and each
    pair with different labels its capacity. A tie is dropped: kept is what the source still reaches.

    A block whose own cost outweighs all its edges has its label in every optimum; such blocks are settled first and
    their edges become costs of their neighbours. What is left is solved by augmenting paths.
    """
    n = len(costs)
    costs = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in pairs:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    room = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(costs[i]) > room[i]:
            label[i] = costs[i] > 0
            for j, c in near[i].items():
                if label[j] is None:
                    costs[j] += c if label[i] else -c
                    room[j] -= c
                    todo.append(j)
    for start in range(n):
        if label[start] is None:
            free, k = [start], 0  # the blocks still open that hang together
            seen = {start}
            while k < len(free):
                more = [j for j in near[free[k]] if label[j] is None and j not in seen]
                seen.update(more)
                free += more
                k += 1
            for i, keep in max_flow(sorted(free), costs, near).items():
                label[i] = keep
    return [bool(x) for x in label]


def max_flow(free: list[int], costs: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Shortest augmenting paths from the source (kept) to the sink (dropped) over the free blocks."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: {j: c for j, c in near[i].items()} for i in free}
    inside = set(free)
    for i in free:
        cap[i] = {j: c for j, c in cap[i].items() if j in inside}
    cap[s] = {i: costs[i] for i in free if costs[i] > 0}
    cap[t] = {}
    for i in free:
        if costs[i] < 0:
            cap[i][t] = -costs[i]
    while True:
        came, queue = {s: s}, deque([s])
        while queue and t not in came:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if t not in came:
            return {i: i in came for i in free}
        path, v = [], t
        while v != s:
            path.append((came[v], v))
            v = came[v]
        push = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= push
            if u != s and v != t:
                cap[v][u] = cap[v].get(u, 0.0) + push


def main_text(page: str | None) -> str:
    """The kept blocks of a page, a line each; empty for null and empty pages."""
    bs = blocks(page or "")
    if not bs:
        return ""
    keep = min_cut(costs(bs), edges(bs))
    return "\n".join(b.text for b, k in zip(bs, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows and columns of pages, whatever their names, and a last column __text.

    Pages are read whole, one at a time; a null or empty page has the empty text; equal pages have equal texts and repeated
    rows stay; a block whose costs tie is dropped; an empty table stays empty.
    """
    common.bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in page], dtype=object)

    return pages.select(*(pages[c] for c in pages.columns), text(pages[html_col]).alias("__text"))
