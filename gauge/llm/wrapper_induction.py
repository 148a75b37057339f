"""Main text of web pages by wrapper induction.

Pages of one host are parsed into trees and aligned, one after another, with a growing wrapper by simple tree
matching: the largest set of matched nodes that keeps order and ancestry. A wrapper's node whose text hardly
varies among distinct pages is template; what varies is content. The article's place is the wrapper's: from the
root down, the element that holds nearly all varying text outside links, as long as no heading that varies stands
beside it. Names of elements, classes and roles only leave out menus, adverts, comments and the like within that
place, and find the article on hosts with fewer than ``LEAST_PAGES`` distinct pages.

A host has one wrapper. Its nodes come from at most ``WRAPPER_PAGES`` of its distinct pages, those with the
smallest digests; the counts of texts in its nodes, and so templates and place, come from all its distinct pages,
summed by Spark. So a page's text depends on its html and its host's distinct pages alone: not on how rows are dealt,
nor on copies. Pages are distinct if the texts of their blocks are; each copy counts its share of one page.

Html is never gathered by host, but for the pages that the wrappers are made from. Wrappers are sent to the tasks
that read pages while all of them have ``SENT_BYTES`` at most; beyond, pages and wrappers meet by host, in parts.

Defined results: null and empty html has empty text; a null or odd url makes a host of its own; a null page_id
stays null; repeated rows repeat their result; an empty table gives an empty result; further columns pass by
unread. Within a block, every run of white space is one space; a line break is white space. A tag that no ``>``
ends before the page does ends the page. Elements may be nested without bound.
"""

from __future__ import annotations

import hashlib
import html as references
import pickle
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.llm.common import Tables, trimmed

#: Distinct pages that give a wrapper its nodes, at most; that a host with a wrapper has, at least; share of them that have one text in a template's node.
WRAPPER_PAGES, LEAST_PAGES, CONSTANT_SHARE = 64, 4, 0.8
#: Bytes of wrappers, and rows of other tables, that are sent to all tasks at most; pages of a part of a host, about, where wrappers are not sent.
SENT_BYTES, SENT_ROWS, PART_PAGES = 48 << 20, 1_000_000, 1024
#: Wrappers that a task keeps ready; shapes of subtrees that it knows.
READY_WRAPPERS, KNOWN_SHAPES = 256, 500_000
#: Least share of its parent's varying text that the article's place holds; cells of a matching table that is kept whole (larger ones are matched in halves).
PLACE_SHARE, TABLE_CELLS = 0.8, 1 << 21

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are never part of an article's text.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg button select option textarea menu dialog object canvas audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp nobr".split())
#: Words of class and id values, and roles, of parts that are not the article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar widget menu menus nav navbar navigation navigator breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup signin login popup modal overlay search searchbox pagination pager skip tags rss legal copyright disclaimer".split()
)
#: Whole class and id values of parts within an article that do not belong to it.
DROPPED_INSIDE = frozenset("ad ads advert advertisement advertising sponsor sponsored promo comment comments commentlist cookie newsletter share sharing social related recommended breadcrumb breadcrumbs pagination".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Elements that a start tag of the same kind, or of a block, ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements within which such an ending stays.
HOLDERS = frozenset("ul ol dl table td th body html article section div main aside nav blockquote form header footer".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["']))*+)>|<(?=/?[A-Za-z])""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element, or (tag ``#``) a text."""

    __slots__ = ("tag", "children", "text", "names", "whole", "hidden", "role", "parent", "shape", "template", "slot", "place")

    def __init__(self, tag: str, parent: Node | None = None, text: str = ""):
        self.tag, self.parent, self.text, self.children = tag, parent, text, []
        self.names, self.whole, self.role, self.hidden, self.template, self.shape, self.slot, self.place = (), (), "", False, False, 0, None, False


def parse(page: str) -> Node:
    """The tree of a page. Unclosed and stray tags are allowed; an attribute-only difference makes no other node."""
    root = Node("#root")
    at, top, n = 0, root, len(page)
    open_tags: Counter[str] = Counter()  # so that no ancestors are walked for a tag that none of them has

    def leave(to: Node) -> Node:
        node = top
        while node is not to:
            open_tags[node.tag] -= 1
            node = node.parent
        return to

    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not text.isspace():
            top.children.append(Node("#", top, references.unescape(text)))
        elif text and top.children:
            top.children.append(Node("#", top, " "))
        if not m:
            break
        at = m.end()
        if m[0] == "<":  # the page ends within a tag
            break
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_tags[tag]:
                node = top
                while node.tag != tag:
                    node = node.parent
                top = leave(node.parent)
            continue
        ended = ENDS.get(tag)
        if ended is None and tag not in INLINE and tag not in VOID or tag == "hr":
            ended = {"p"}
        if ended and (left := sum([open_tags[x] for x in ended])):
            node, last = top, None
            while node is not root and (node.tag in ended or node.tag not in HOLDERS):
                if node.tag in ended:
                    last, left = node, left - 1
                    if not left:
                        break
                node = node.parent
            if last is not None:
                top = leave(last.parent)
        node = Node(tag, top)
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    node.names += tuple(_NAME.findall(value.lower()))
                    node.whole += tuple(value.lower().split())
                elif key == "role":
                    node.role = value.strip().lower()
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                    node.hidden = True
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("path", "circle", "rect", "g", "use")):
            top = node  # a slash does not end an element of html
            open_tags[tag] += 1
    return root


def _elements(node: Node) -> list[Node]:
    """The nodes that are aligned: elements, and texts that hold more than white space."""
    return [c for c in node.children if c.tag != "#" or not c.text.isspace()]


def _label(node: Node) -> tuple:
    return node.tag, node.names


def _shapes(root: Node, numbers: dict) -> int:
    """A number for each subtree's labels, so that equal shapes are matched at once. Gives the depth."""
    order, deepest = [(root, 1)], 0
    for node, depth in order:  # grows while it is read: parents before children
        deepest = max(deepest, depth)
        order += [(c, depth + 1) for c in _elements(node)]
    for node, _ in reversed(order):
        key = (_label(node), tuple([c.shape for c in _elements(node)]))
        node.shape = numbers.setdefault(key, len(numbers))
    return deepest


class Slot:
    """A node of a wrapper: its place in it, and the digests of its template texts."""

    __slots__ = ("label", "children", "shape", "size", "weight", "number", "constant")

    def __init__(self, node: Node):
        self._take(node)
        order, todo = [], [(self, node)]
        while todo:
            slot, x = todo.pop()
            order.append(slot)
            for c in _elements(x):
                own = Slot.__new__(Slot)
                own._take(c)
                slot.children.append(own)
                todo.append((own, c))
        for slot in reversed(order):
            slot.size += sum([c.size for c in slot.children])

    def _take(self, node: Node) -> None:
        self.label, self.shape, self.weight = _label(node), node.shape, 0
        self.children, self.size, self.number, self.constant = [], 1, 0, frozenset()


def match_size(a: Slot, b: Node, memo: dict) -> int:
    """Simple tree matching: the number of pairs in the largest match of two trees."""
    if a.label != _label(b):
        return 0
    if a.shape == b.shape:
        return a.size
    key = (id(a), b.shape)
    if key not in memo:
        memo[key] = 1 + _table(a, _elements(b), memo)[0]
    return memo[key]


def _table(a: Slot, right: list[Node], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """The best order-preserving match of two child lists: its size and its pairs of positions."""
    left = a.children
    pairs, head, total = [], 0, 0
    while head < min(len(left), len(right)) and left[head].shape == right[head].shape and left[head].label == _label(right[head]):
        pairs.append((head, head))
        total += left[head].size
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail].shape == right[-1 - tail].shape and left[-1 - tail].label == _label(right[-1 - tail]):
        total += left[-1 - tail].size
        tail += 1
    m, n = len(left) - head - tail, len(right) - head - tail
    if m and n:
        # children of one shape match alike, so each is compared once
        shapes = {right[head + j].shape: j for j in range(n)}
        place = {x: k for k, x in enumerate(shapes)}
        own = np.array([place[right[head + j].shape] for j in range(n)])
        weights = []
        for i in range(m):
            row = []
            for j in shapes.values():
                row.append(match_size(left[head + i], right[head + j], memo))
            weights.append(np.array(row, np.int64))
        size, middle = _chain(weights, own)
        total += size
        pairs += [(head + i, head + j) for i, j in middle]
    pairs += [(len(left) - t, len(right) - t) for t in range(tail, 0, -1)]
    return total, pairs


def _row(above: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The next row of a matching table: the best of leaving either one out, or of a pair."""
    took = np.where(weight > 0, above[:-1] + weight, 0)
    return np.maximum.accumulate(np.concatenate([[0], np.maximum(above[1:], took)]))


def _chain(weights: list[np.ndarray], own: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest chain of pairs (i, j) that rises in both; ``weights[i][own[j]]`` is a pair's weight, 0 for none."""
    m, n = len(weights), len(own)
    if m > 1 and m * n > TABLE_CELLS:  # in halves: where the best chain passes from one to the other needs two rows only
        half, down, up = m // 2, np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for w in weights[:half]:
            down = _row(down, w[own])
        for w in weights[half:][::-1]:
            up = _row(up, w[own[::-1]])
        cut = int((down + up[::-1]).argmax())
        one, two = _chain(weights[:half], own[:cut]), _chain(weights[half:], own[cut:])
        return one[0] + two[0], one[1] + [(half + i, cut + j) for i, j in two[1]]
    best = np.zeros((m + 1, n + 1), np.int64)
    for i, w in enumerate(weights):
        best[i + 1] = _row(best[i], w[own])
    i, j, pairs = m, n, []
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return int(best[m, n]), pairs[::-1]


def align(wrapper: Slot, page: Node, memo: dict) -> None:
    """Matches a page to the wrapper, which takes on the page's other nodes."""
    own = _elements(page)
    if not own:
        return
    pairs = _table(wrapper, own, memo)[1]
    matched = {j: i for i, j in pairs}
    added, after = [], -1
    for j, node in enumerate(own):
        if j in matched:
            after = matched[j]
            align(wrapper.children[after], node, memo)
        else:
            added.append((after, Slot(node)))
    if added:
        children, k = [], 0
        for i in range(-1, len(wrapper.children)):
            if i >= 0:
                children.append(wrapper.children[i])
            while k < len(added) and added[k][0] == i:
                children.append(added[k][1])
                k += 1
        wrapper.children = children
        wrapper.size = 1 + sum([c.size for c in children])
        wrapper.shape = -1  # like no page's any more


def fit(wrapper: Slot, page: Node, memo: dict) -> None:
    """Gives a page's nodes their slots in a wrapper that stays as it is; nodes without one keep none."""
    page.slot = wrapper
    own = _elements(page)
    if own:
        key = (wrapper.number, page.shape, "pairs")  # children of equal shapes match alike
        if key not in memo:
            memo[key] = _table(wrapper, own, memo)[1]
        for i, j in memo[key]:
            fit(wrapper.children[i], own[j], memo)


@contextmanager
def _deep(depth: int) -> Iterator[None]:
    """Within it, functions may call themselves down trees of this depth."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 8 * depth + 10_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(limit)


def induced(pages: list[str]) -> Slot:
    """The wrapper of some pages of one host."""
    trees, numbers = [parse(p) for p in pages], {}
    with _deep(max([_shapes(tree, numbers) for tree in trees])):
        wrapper = Slot(trees[0])
        for tree in trees:
            align(wrapper, tree, {})
    return wrapper


def to_bytes(wrapper: Slot) -> bytes:
    """A wrapper's nodes, each before its children, with their labels and numbers of children."""
    out, todo = [], [wrapper]
    while todo:
        slot = todo.pop()
        out.append((slot.label, len(slot.children)))
        todo += slot.children[::-1]
    return zlib.compress(pickle.dumps(out))


def from_bytes(data: bytes, numbers: dict) -> tuple[Slot, int]:
    """The wrapper with its nodes numbered in their order, and its depth; ``numbers`` are those of the shapes."""
    slots: list[Slot] = []
    open_: list[tuple[Slot, int]] = []
    deepest = 0
    for label, n in pickle.loads(zlib.decompress(data)):
        slot = Slot.__new__(Slot)
        slot.label, slot.children, slot.size, slot.weight, slot.number, slot.constant = label, [], 1, 0, len(slots), frozenset()
        while open_ and len(open_[-1][0].children) == open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].children.append(slot)
        open_.append((slot, n))
        deepest = max(deepest, len(open_))
        slots.append(slot)
    for slot in reversed(slots):
        slot.size += sum([c.size for c in slot.children])
        slot.shape = numbers.setdefault((slot.label, tuple([c.shape for c in slot.children])), len(numbers))
    return slots[0], deepest


def _inside(node: Node) -> bool:
    """Whether an element is within an article, or where the wrapper says that it is."""
    up = node.parent
    while up is not None and not up.place and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None


def dropped(node: Node) -> bool:
    """Whether an element's marks say that it is not part of an article. Within one, only whole names count."""
    if node.place:
        return False
    if node.tag in DROPPED or node.hidden or node.role in DROPPED_ROLES:
        return True
    if node.tag in ("article", "main", "body", "html"):
        return node.tag == "article" and bool({"comment", "comments", "reply"} & set(node.names))
    if node.tag == "header":  # an article's own heading is part of it
        return not _inside(node)
    if node.tag == "h1" or not DROPPED_NAMES & set(node.names):
        return False
    return bool(DROPPED_INSIDE & set(node.whole)) or not _inside(node)


def _kept_size(root: Node) -> int:
    todo, size = [root], 0
    while todo:
        node = todo.pop()
        if node.tag == "#":
            size += 0 if node.template else len(node.text)
        elif node is root or not dropped(node):
            todo += node.children
    return size


def _mains(root: Node, tags: tuple[str, ...]) -> list[Node]:
    """The outermost elements with one of the tags, in page order."""
    todo, out = [root], []
    while todo:
        node = todo.pop()
        if node is not root and (node.tag in tags or node.role == "main" and "main" in tags):
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if c.tag != "#" and not dropped(c)]
    return out


def blocks(node: Node) -> list[str]:
    """The blocks of what is left of a tree, in page order."""
    out: list[str] = []
    line: list[str] = []
    varying = [False]  # a block of which some text varies is kept whole

    def close() -> None:
        if varying[0] and (text := " ".join("".join(line).split())):
            out.append(text)
        line.clear()
        varying[0] = False

    todo: list = [iter(node.children)]
    ends: list[bool] = []  # for each element that is open, whether it is a block
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
            if ends and ends.pop():
                close()
        elif c.tag == "#":
            line.append(c.text)
            varying[0] |= not c.template and not c.text.isspace()
        elif c.tag in ("br", "wbr"):
            line.append(" " if c.tag == "br" else "")
        elif dropped(c):
            if c.tag not in INLINE:
                close()
        else:
            if c.tag not in INLINE:
                close()
            todo.append(iter(c.children))
            ends.append(c.tag not in INLINE)
    close()
    return out


def main_text(page: Node) -> str:
    """The text at the article's place by the wrapper, or of the largest article or main element, or else of all that is left of the page."""
    todo = [page]
    while todo:
        node = todo.pop()
        if node.place:
            return "\n".join(blocks(node))
        todo += node.children
    for tags in (("article",), ("main",)):
        if found := [(_kept_size(x), x) for x in _mains(page, tags)]:
            size = max(n for n, _ in found)
            if size:
                return "\n".join(blocks(next(x for n, x in found if n == size)))
    return "\n".join(blocks(page))


HEADINGS = frozenset("h1 h2 h3".split())


_LINKS = frozenset(("a", "button", "select", "option", *RAW))


def _weigh(root: Slot, own: dict[int, float]) -> None:
    """Gives each slot the length of its texts that vary and are not in links; ``own`` has each slot's, by number."""
    order, inside = [root], {id(root): False}
    for slot in order:
        link = inside[id(slot)] or slot.label[0] in _LINKS
        for c in slot.children:
            inside[id(c)] = link
            order.append(c)
    for slot in reversed(order):
        slot.weight = (0 if inside[id(slot)] or slot.label[0] in _LINKS else own.get(slot.number, 0)) + sum([c.weight for c in slot.children])


def _has(slot: Slot, tags: frozenset) -> bool:
    todo = [slot]
    while todo:
        x = todo.pop()
        if x.label[0] in tags and x.weight:
            return True
        todo += x.children
    return False


def place_of(root: Slot, own: dict[int, float]) -> Slot | None:
    """The slot of the article: from the root down, the element with nearly all varying text, up to where a heading stands beside it."""
    _weigh(root, own)
    at = root
    while True:
        elements = [c for c in at.children if c.label[0] != "#" and c.label[0] not in INLINE]
        best = max(elements, key=lambda c: c.weight, default=None)
        if best is None or best.weight < PLACE_SHARE * max(1, at.weight):
            break
        if not any(c.label[0] != "#" and c.label[0] not in INLINE for c in best.children):
            break  # a paragraph is not a place
        if at.label[0] not in ("#root", "html") and any(c is not best and _has(c, HEADINGS) for c in at.children):
            break
        at = best
    return at if at.label[0] not in ("#root", "html", "body") else None


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _texts(root: Node) -> Iterator[tuple[Node, int, bool]]:
    """The texts of a page that was fitted, with the number of the nearest node's slot, and whether they count as varying for sure."""
    todo = [(root, 0, False)]
    while todo:
        node, number, link = todo.pop()
        if node.tag == "#":
            if node.slot is not None:
                yield node, node.slot.number, False
            elif not link and not node.text.isspace():
                yield node, number, True
            continue
        number = node.slot.number if node.slot is not None else number
        link = link or node.slot is None and node.tag in _LINKS
        todo += [(c, number, link) for c in node.children]


def _mark(root: Node, place: Slot | None) -> None:
    """Marks the article's place, and texts that are template in their slot."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.slot is None:
            continue
        if node.tag == "#":
            node.template = bool(node.slot.constant) and _digest(" ".join(node.text.split())) in node.slot.constant
        else:
            node.place = node.slot is place
            todo += node.children


class Wrappers:
    """Wrappers of hosts, as they are needed; ``find`` gives a host's row, or None."""

    def __init__(self, find: Callable[[str], dict | None]):
        self.find, self.ready, self.numbers = find, {}, {}

    def fitted(self, host_name: str, page: str) -> tuple[Node, Slot | None, bool]:
        """A page's tree with its slots, the article's place, and whether its host has a wrapper."""
        tree, row = parse(page), self.find(host_name)
        if row is None:
            return tree, None, False
        if len(self.numbers) > KNOWN_SHAPES or len(self.ready) > READY_WRAPPERS:
            self.ready, self.numbers = {}, {}
        if host_name not in self.ready:
            wrapper, depth = from_bytes(row["wrapper"], self.numbers)
            place = place_of(wrapper, {x["number"]: x["chars"] for x in row["weights"]}) if row.get("weights") is not None else None
            constant: dict[int, set[int]] = {}
            for x in row.get("constants") or ():
                constant.setdefault(x["number"], set()).add(x["digest"])
            todo = [wrapper] if constant else []
            while todo:
                slot = todo.pop()
                slot.constant = frozenset(constant.get(slot.number, ()))
                todo += slot.children
            self.ready[host_name] = wrapper, depth, place, {}
        wrapper, depth, place, memo = self.ready[host_name]
        with _deep(depth + _shapes(tree, self.numbers)):
            fit(wrapper, tree, memo)
        return tree, place, True


def host(url: str = "url") -> F.Column:
    """The host of a url, lower-cased; an odd url stands for itself."""
    found = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found).otherwise(F.coalesce(F.col(url), F.lit("")))


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return own.withColumns({"host": host(), "page": F.unhex(F.md5("html"))})


def _distinct(rows: DataFrame) -> DataFrame:
    """host, page (digest of the html) and content (digest of its blocks' texts), with the number of such rows."""

    @trimmed
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.md5("\n".join(blocks(parse(p))).encode("utf-8", "surrogatepass")).digest() for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["host", "page", "content"])

    return rows.select("host", "page", "html").mapInArrow(digests, "host string, page binary, content binary").groupBy("host", "page", "content").agg(F.count(F.lit(1)).alias("rows"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _wrappers(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """host, n (its distinct pages) and wrapper of hosts with pages enough; ``contents`` has one row for each of them."""
    order = F.row_number().over(W.partitionBy("host").orderBy("content"))
    sizes = contents.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    chosen = contents.withColumn("place", order).where(F.col("place") <= WRAPPER_PAGES).join(sizes, "host", "left_semi").select("host", "page", "place")
    htmls = rows.select("host", "page", "html").join(_small(chosen), ["host", "page"])

    @trimmed
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # at most the pages that are chosen
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keep = []
            for k in keys:
                keep.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(keep))

    def induce(group: pa.Table) -> pa.Table:
        pages = dict(zip(group["place"].to_pylist(), group["html"].to_pylist(), strict=True))
        return pa.table({"host": group["host"][:1], "wrapper": pa.array([to_bytes(induced([pages[k] for k in sorted(pages)]))], pa.binary())})

    few = htmls.select("host", "place", "html").mapInArrow(once, "host string, place int, html string")
    return few.groupBy("host").applyInArrow(induce, "host string, wrapper binary").join(sizes, "host")


def _each(rows: DataFrame, models: DataFrame, work: Callable[[Wrappers, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on batches of ``rows``, which have host, with the wrappers of their hosts."""
    size = models.agg(F.sum(F.length("wrapper") + 200)).first()[0] or 0
    if size <= SENT_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast({r["host"]: r.asDict() for r in models.collect()})  # of a size that was just checked

        @trimmed
        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wrappers = Wrappers(sent.value.get)
            for batch in batches:
                yield work(wrappers, batch)

        return rows.mapInArrow(alone, schema)
    parts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PART_PAGES).cast("int").alias("parts"))
    dealt = rows.join(_small(parts), "host").withColumn("part", F.pmod(F.xxhash64("page", F.rand(7)), F.col("parts")).cast("int")).select("part", *rows.columns)
    copies = models.join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def together(group: pa.Table, model: pa.Table) -> pa.Table:
        own = model.to_pylist()
        wrappers = Wrappers(lambda _: own[0] if own else None)
        group = group.drop_columns(["part"])
        return pa.Table.from_batches([work(wrappers, b) for b in group.to_batches() or [pa.RecordBatch.from_pylist([], schema=group.schema)]])

    return dealt.groupBy("host", "part").cogroup(copies.groupBy("host", "part")).applyInArrow(together, schema)


def _counted(wrappers: Wrappers, batch: pa.RecordBatch) -> pa.RecordBatch:
    """How many distinct pages have a text in a slot, and how long it is; null for texts without a slot."""
    total: dict[tuple, list[float]] = {}
    for name, page, share in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
        tree, _, has = wrappers.fitted(name, page)
        for node, number, varies in _texts(tree) if has else ():
            text = " ".join(node.text.split())
            entry = total.setdefault((name, number, None if varies else _digest(text)), [0.0, 0.0])
            entry[0] += share
            entry[1] += share * len(text)
    keys = list(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([total[k][0] for k in keys], pa.float64()), pa.array([total[k][1] for k in keys], pa.float64())],
        names=["host", "number", "digest", "n", "chars"],
    )


def _extracted(wrappers: Wrappers, batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for name, page in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
        tree, place, has = wrappers.fitted(name, page)
        if has:
            _mark(tree, place)
        out.append(main_text(tree))
    return pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def models(rows: DataFrame, tables: Tables) -> DataFrame:
    """The wrapper of each host with pages enough, its template texts and the lengths of its varying texts, by slot."""
    distinct = tables.keep("distinct", _distinct(rows))
    contents = tables.keep("contents", distinct.groupBy("host", "content").agg(F.min("page").alias("page"), F.sum("rows").alias("copies")))
    wrappers = tables.keep("wrappers", _wrappers(rows, contents))
    again = distinct.join(contents.where("copies > 1").select("host", "content", "copies"), ["host", "content"]).select("host", "page", "copies")
    weighted = rows.select("host", "page", "html").join(_small(again), ["host", "page"], "left")
    weighted = weighted.select("host", "page", "html", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    counts = _each(weighted, wrappers, _counted, "host string, number int, digest long, n double, chars double")
    pages = wrappers.select("host", F.col("n").alias("pages"))
    sums = counts.groupBy("host", "number", "digest").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).join(_small(pages), "host")
    constant = F.col("digest").isNotNull() & (F.col("n") >= CONSTANT_SHARE * F.col("pages") - 1e-6)
    slots = sums.groupBy("host", "number").agg(F.sum(F.when(~constant, F.col("chars"))).alias("chars"), F.collect_list(F.when(constant, F.col("digest"))).alias("digests"))
    # a row a slot of the wrapper; at most one text is that common in it
    told = slots.groupBy("host").agg(
        F.collect_list(F.when(F.col("chars") > 0, F.struct("number", "chars"))).alias("weights"),
        F.flatten(F.collect_list(F.transform("digests", lambda d: F.struct("number", d.alias("digest"))))).alias("constants"),
    )
    return tables.keep("models", wrappers.join(told, "host", "left"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    tables = Tables(pages.sparkSession, "wrappers")
    rows = _rows(pages)
    found = models(rows, tables)
    tables.drop("distinct", "contents", "wrappers")
    return _each(rows.select("host", "page", "page_id", "url", "html"), found, _extracted, "page_id long, url string, text string, n_chars long")
