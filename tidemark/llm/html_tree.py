"""A small tolerant HTML tree for extraction, and the alignment of two trees."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import numpy as np

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul caption button".split()
)
#: A start tag closes open elements of these kinds, up to the bound.
_CLOSES = {t: (("p",), ()) for t in BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "html", "body", "button"}}
_CLOSES |= {
    "li": (("li", "p"), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("table", "tr")), "th": (("td", "th", "p"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}
#: What can stand in a head; any other element or text ends it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta".split()) | RAW
_SCOPE = frozenset("table td th caption button html body".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "label", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.label = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}"

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def parse(source: str) -> Node:
    """The tree of a page. Character references in text are decoded; comments and raw elements are left out."""
    root = Node("#root", {})
    stack, at = [root], 0
    where: dict[str, list[int]] = defaultdict(list)  # the places in the stack of open elements of each kind
    blocks: list[int] = []  # and of open blocks
    end, last = len(source), source.rfind(">")

    def cut(i: int) -> None:
        for n in stack[i:]:
            where[n.tag].pop()
        while blocks and blocks[-1] >= i:
            blocks.pop()
        del stack[i:]

    def top(kinds) -> int:
        return max((where[k][-1] for k in kinds if where.get(k)), default=0)

    while at < end:
        m = _TAG.search(source, at) if at <= last else None
        text = source[at : m.start() if m else end]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            i = top((tag,))
            if i and (tag in BLOCKS or not blocks or blocks[-1] < i):  # else a stray end tag
                cut(i)
            elif not i and tag == "p":  # a stray one still ends a paragraph
                stack[-1].children.append(Node("p", {}))
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = closing.end() if closing else end
            continue
        if tag not in _IN_HEAD and (i := top(("head",))):
            cut(i)
        if tag in _CLOSES:
            kinds, bound = _CLOSES[tag]
            while (i := top(kinds)) and i > top(bound or _SCOPE - set(kinds)):
                cut(i)
        attrs = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTR.findall(m[3] or m[6] or "")}
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            where[tag].append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(node)
    return root


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def own_text(node: Node) -> str:
    """The text of a node outside of block elements in it; a line break counts as a space."""
    out: list[str] = []
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in BLOCKS or c.tag == "br":
            out.append(" ")
        else:
            todo += reversed(c.children)
    return clean("".join(out))


#: Child lists whose lengths multiply to more are matched by rows of arrays, with the same result.
_LONG = 2_000


def _same_start(xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
    """How many items at the start of both are equal."""
    n = 0
    for x, y in zip(xs, ys):
        if x != y:
            break
        n += 1
    return n


def _without_ends(xs: tuple[int, ...], ys: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Both without what they begin and end with alike; that is in a largest matching of child lists."""
    start = _same_start(xs, ys)
    end = _same_start(xs[start:][::-1], ys[start:][::-1])
    return xs[start : len(xs) - end], ys[start : len(ys) - end]


def _next_row(before: list[int], weights: list[int]) -> list[int]:
    """The largest sums for each stretch of the other list, with one more item that has these weights."""
    row, most, diagonal = [0], 0, 0
    for above, w in zip(before[1:], weights, strict=True):
        if w and diagonal + w > most:
            most = diagonal + w
        if above > most:
            most = above
        row.append(most)
        diagonal = above
    return row


class Shapes:
    """Shapes of trees, numbered: a label and the shapes of the child elements. The largest matching of
    two trees depends on their shapes alone, so that of two shapes is worked out once."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.of: dict[int, int] = {}  # by id of a node; the nodes live as long
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.count: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def add(self, root: Node) -> None:
        if id(root) in self.of:
            return
        order, todo = [], [root]
        while todo:
            n = todo.pop()
            order.append(n)
            todo += n.elements()
        for n in reversed(order):
            kids = tuple(self.of[id(c)] for c in n.elements())
            key = (n.label, kids)
            if key not in self.known:
                self.known[key] = len(self.label)
                self.label.append(n.label)
                self.kids.append(kids)
                self.count.append(1 + sum(self.count[k] for k in kids))
            self.of[id(n)] = self.known[key]

    def _one(self, s: int, t: int) -> int | None:
        if self.label[s] != self.label[t]:
            return 0
        return self.count[s] if s == t else self.sizes.get((s, t))

    def size(self, s: int, t: int) -> int:
        """The nodes in the largest matching of two trees that keeps parents and the order of children."""
        todo = [(s, t)]
        while todo:
            a, b = todo[-1]
            if self._one(a, b) is None:
                xs, ys = _without_ends(self.kids[a], self.kids[b])
                other: dict[str, set[int]] = defaultdict(set)
                for y in ys:
                    other[self.label[y]].add(y)
                before = [(x, y) for x in set(xs) for y in other.get(self.label[x], ()) if self._one(x, y) is None]
                if before:
                    todo += before
                    continue
                ends = self.count[a] - 1 - sum(self.count[x] for x in xs)
                self.sizes[a, b] = 1 + ends + self._most(xs, ys)
            todo.pop()
        return self._one(s, t)

    def _weights(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> dict[int, list[int] | None]:
        """For each shape of ``xs`` the sizes of its matchings with ``ys``; None if all are 0."""
        at: dict[str, list[int]] = defaultdict(list)
        for j, y in enumerate(ys):
            at[self.label[y]].append(j)
        out: dict[int, list[int] | None] = {}
        for x in xs:
            if x not in out:
                out[x] = None
                if places := at.get(self.label[x]):
                    out[x] = row = [0] * len(ys)
                    for j in places:
                        row[j] = self.size(x, ys[j])
        return out

    def _most(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
        """The largest sum of matchings of two child lists that begin and end differently."""
        if not xs or not ys:
            return 0
        if len(xs) * len(ys) > _LONG:
            return sum(self._one(xs[i], ys[j]) for i, j in self._long_pairs(xs, ys))
        weights, row = self._weights(xs, ys), [0] * (len(ys) + 1)
        for x in xs:
            if weights[x]:
                row = _next_row(row, weights[x])
        return row[-1]

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The places of children, last first, whose matchings are largest in sum.

        Equal shapes at the start of both go together: no other matching of theirs is larger, and the
        way back through the rows comes to them whatever follows.
        """
        same = _same_start(xs, ys)
        start = [(i, i) for i in range(same - 1, -1, -1)]
        xs, ys = xs[same:], ys[same:]
        if not xs or not ys:
            return start
        if len(xs) * len(ys) > _LONG:
            return [(i + same, j + same) for i, j in self._long_pairs(xs, ys)] + start
        weights, rows = self._weights(xs, ys), [[0] * (len(ys) + 1)]
        for x in xs:
            rows.append(_next_row(rows[-1], weights[x]) if weights[x] else rows[-1])
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i + same, j + same))
        return out + start

    def _long_pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The same by the same rows, of which only some are kept and the others made again on the way back."""
        kinds, at = np.unique(np.array(ys), return_inverse=True)
        weights: dict[int, np.ndarray] = {}

        def following(before: np.ndarray, x: int) -> np.ndarray:
            if x not in weights:
                weights[x] = np.array([self.size(x, y) for y in kinds.tolist()], dtype=np.int64)
            row = before.copy()
            np.maximum(row[1:], before[:-1] + weights[x][at], out=row[1:])
            return np.maximum.accumulate(row)

        step = math.isqrt(len(xs)) + 1
        row = np.zeros(len(ys) + 1, dtype=np.int64)
        kept = []
        for i, x in enumerate(xs):
            if i % step == 0:
                kept.append(row)
            row = following(row, x)
        out, j = [], len(ys)
        for k in range(len(kept) - 1, -1, -1):
            rows = [kept[k]]
            for x in xs[k * step : (k + 1) * step]:
                rows.append(following(rows[-1], x))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((k * step + i, j))
        return out


def align(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """The pairs of nodes that simple tree matching puts together. ``shapes`` keeps what is known of trees that live on."""
    shapes = shapes or Shapes()
    shapes.add(a)
    shapes.add(b)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        xs, ys = x.elements(), y.elements()
        if not xs or not ys:
            continue
        if shapes.of[id(x)] == shapes.of[id(y)]:
            todo += zip(reversed(xs), reversed(ys), strict=True)
        else:
            todo += [(xs[i], ys[j]) for i, j in shapes.pairs(tuple(shapes.of[id(c)] for c in xs), tuple(shapes.of[id(c)] for c in ys))]
    return out
