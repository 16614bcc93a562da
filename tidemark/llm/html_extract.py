"""Main text of web pages by wrapper induction.

Pages of a host are taken in groups of bounded size. In a group, the trees of different pages are
aligned with two pivot pages by simple tree matching: a node that has the same text on most pages is
template, what varies is a slot. The pivots are the page with the most elements and the first one, so
that a part that one of them lacks is still met. The main region is found by the slots' text: from the
root on, the container that holds most of what varies, over all pages, as long as one does. Where
mark-up has an article or main element, that is the region. Within it, blocks that mark-up declares
to be menus, adverts, forms, comments and the like are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .html_tree import BLOCKS, Node, Shapes, align, clean, own_text, parse

#: Elements, roles and words in class or id that mark what isn't main text.
NOT_MAIN = frozenset("nav aside footer form menu dialog button select fieldset search head audio video canvas map label input datalist output progress".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "footer masthead sidebar side widget widgets cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations trending popular comment comments disqus respond reply replies discussion pagination pager toolbar tags search skip banner copyright legal".split()
)
#: Elements that can hold a page's main region.
_CONTAINERS = frozenset("html body div main article section center table tbody tr td form".split())
#: A container is gone into if it holds so much of what varies.
REGION_SHARE = 0.6
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_main(n: Node) -> bool:
    return n.tag in ("article", "main") or n.attrs.get("role") == "main" or n.attrs.get("itemprop") == "articleBody"


def _left_out(n: Node, in_main: bool) -> bool:
    a = n.attrs
    if n.tag in NOT_MAIN or a.get("role", "").lower() in NOT_MAIN_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    if n.tag == "header" and not in_main:
        return True
    if n.tag in ("body", "html", "article", "main") and not in_main:
        return False
    words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{a.get('class', '')} {a.get('id', '')}").lower()))
    return bool(words & NOT_MAIN_WORDS) or "header" in words and not in_main


def _blocks(root: Node) -> list[tuple[Node, int, str, bool, bool]]:
    """``(node, run, text, left out, in main)`` of each stretch of text, in page order. A run is text between blocks."""
    out: list[tuple[Node, int, str, bool, bool]] = []

    class Block:
        __slots__ = ("buffer", "left", "main", "n", "run")

        def __init__(self, n: Node, left: bool, main: bool):
            self.n, self.left, self.main, self.run, self.buffer = n, left, main, 0, []

        def flush(self) -> None:
            if text := clean("".join(self.buffer)):
                out.append((self.n, self.run, text, self.left, self.main))
                self.run += 1
            self.buffer.clear()

    # children still to be read: of a block, and of inline elements in it
    todo = [(iter(root.children), Block(root, False, False), True)]
    while todo:
        rest, block, own = todo[-1]
        for c in rest:
            if isinstance(c, str):
                block.buffer.append(c)
            elif c.tag == "br":
                block.buffer.append(" ")
            elif c.tag in BLOCKS or _is_main(c):
                block.flush()
                todo.append((iter(c.children), Block(c, block.left or _left_out(c, block.main), block.main or _is_main(c)), True))
                break
            elif not _left_out(c, block.main):
                todo.append((iter(c.children), block, False))
                break
        else:
            todo.pop()
            if own:
                block.flush()
    return out


def _linked(n: Node) -> bool:
    """Whether over half of a node's own text is links."""
    whole, links = len(own_text(n)), 0
    todo = list(n.children)
    while todo:
        c = todo.pop()
        if isinstance(c, Node):
            if c.tag == "a":
                links += len(own_text(c))
            elif c.tag not in BLOCKS:
                todo += c.children
    return links * 2 > whole


def _elements(root: Node) -> Iterator[tuple[Node, Node]]:
    """``(parent, element)`` of a tree, parents first."""
    todo = [root]
    while todo:
        n = todo.pop()
        for c in n.elements():
            yield n, c
            todo.append(c)


def _region(pivot: Node, trees: list[Node], maps: list[dict[int, int]], texts: list[list[tuple[Node, int]]]) -> list[set[int]]:
    """The nodes of each page that lie in its main region; none for a page without that region.

    ``maps`` gives the pivot's node for each aligned one, ``texts`` the varying text of nodes by its size.
    Text of a node without a counterpart counts for the nearest node above it that has one.
    """
    mass: Counter = Counter()
    for tree, of, own in zip(trees, maps, texts, strict=True):
        anchor = {id(tree): id(pivot)}
        for p, c in _elements(tree):
            anchor[id(c)] = of.get(id(c), anchor[id(p)])
        for n, size in own:
            mass[anchor[id(n)]] += size
    total = Counter(mass)
    for p, c in reversed(list(_elements(pivot))):
        total[id(p)] += total[id(c)]
    now = pivot
    while not _is_main(now):
        inner = [c for c in now.elements() if c.tag in _CONTAINERS and total[id(c)] > REGION_SHARE * total[id(now)]]
        if not inner:
            break
        now = inner[0]
    out: list[set[int]] = []
    for tree, of in zip(trees, maps, strict=True):
        inside = {id(tree)} if now is pivot else set()
        for p, c in _elements(tree):
            if id(p) in inside or of.get(id(c)) == id(now):
                inside.add(id(c))
        out.append(inside)
    return out


def extract(pages: list[str], same_host: bool = True) -> list[str]:
    """The main text of each page; pages of one host, given as HTML, show each other's template.

    Fewer than three distinct pages show none; their mark-up decides alone. Pages that say the same
    count once.
    """
    trees = [parse(p) for p in pages]
    shown = [_blocks(t) for t in trees]
    constant: list[set[tuple[int, int]]] = [set() for _ in pages]
    regions: list[set[int]] = [set() for _ in pages]
    first = {tuple(b[2] for b in s): i for i, s in reversed(list(enumerate(shown)))}  # pages that say the same count once
    distinct = sorted(first.values())
    if same_host and len(distinct) >= 3:
        shapes = Shapes()
        elements = {i: sum(1 for _ in _elements(trees[i])) for i in distinct}
        largest = max(distinct, key=lambda i: (elements[i], -i))
        for p in dict.fromkeys((largest, distinct[0])):
            slot = [{id(y): id(x) for x, y in align(trees[p], t, shapes)} for t in trees]
            said: dict[tuple[int, int], Counter] = defaultdict(Counter)
            for i in distinct:
                for n, run, text, _, _ in shown[i]:
                    if id(n) in slot[i]:
                        said[slot[i][id(n)], run][text] += 1
            for i, s in enumerate(shown):
                for n, run, text, _, _ in s:
                    if id(n) in slot[i] and said[slot[i][id(n)], run][text] >= max(3, 0.6 * len(distinct)):
                        constant[i].add((id(n), run))
            if p == largest:
                largest_slot = slot
        varying = [[(n, len(text)) for n, run, text, left, _ in s if not left and (id(n), run) not in constant[i]] for i, s in enumerate(shown)]
        counted = [x if i in set(distinct) else [] for i, x in enumerate(varying)]
        regions = _region(trees[largest], trees, largest_slot, counted)
    out = []
    for i, s in enumerate(shown):
        kept = [b for b in s if not b[3]]
        bounded = any(b[4] for b in kept)
        if bounded:
            kept = [b for b in kept if b[4]]
        else:
            kept = [b for b in kept if id(b[0]) in regions[i]] or kept
            kept = [b for b in kept if not (_linked(b[0]) and len(b[2]) < 120)]
        varying = [b for b in kept if (id(b[0]), b[1]) not in constant[i]]
        # near copies on a host repeat their article too: that is no template
        of_all, of_varying = (sum(len(b[2]) for b in x) for x in (kept, varying))
        if of_varying >= (0.8 if bounded else 0.1) * of_all:
            kept = varying
        out.append("\n\n".join(b[2] for b in kept))
    return out


def _group(keys: DataFrame, group_pages: int) -> DataFrame:
    """``(host, cuts)`` of the hosts with over ``group_pages`` distinct ``(host, h)``: the least ``h`` of each
    of their groups but the first. A host's groups are as few as can be and differ by one page at most.

    Ranks are exact: leading bits of the hash make ranges, whose counts say what comes before.
    """
    keys = keys.distinct().withColumn("k", F.shiftright("h", 52))
    counts = keys.groupBy("host", "k").agg(F.count("*").alias("c"))
    of_host = Window.partitionBy("host")
    known = counts.withColumns({"n": F.sum("c").over(of_host), "before": F.sum("c").over(of_host.orderBy("k")) - F.col("c")}).where(F.col("n") > group_pages)
    ranked = keys.join(known, ["host", "k"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("host", "k").orderBy("h")) - 1)
    groups = f"ceil(n / {group_pages})"
    starts = ranked.where(f"rank > 0 and rank * {groups} div n > (rank - 1) * {groups} div n")
    return starts.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("cuts"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = 48) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row.

    A host's pages, by a hash of all they are, are dealt evenly to groups of up to ``group_pages``
    distinct ones, whatever the partitions; each group is aligned by itself, and equal rows are read
    once. A null or empty page has an empty text; pages without a host show nobody's template. Other
    columns are not read.
    """
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    own = own.select(host.alias("host"), F.xxhash64("page_id", "url", "html").alias("h"), "page_id", "url", "html")
    cut = own.join(F.broadcast(_group(own.select("host", "h"), group_pages)), "host", "left")
    # how many cuts are not above h, by halving
    at = F.aggregate(F.array(*[F.lit(1 << b) for b in range(24, -1, -1)]), F.lit(0), lambda lo, p: F.when(F.get("cuts", lo + p - 1) <= F.col("h"), lo + p).otherwise(lo))
    grouped = cut.select("host", F.when(F.col("cuts").isNull(), 0).otherwise(at).alias("part"), "page_id", "url", "html", "h")
    dealt = grouped.repartition("host", "part").sortWithinPartitions("host", "part", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        page: dict[str, int] = {}  # each distinct page of the group once
        key = None

        def done() -> pa.RecordBatch:
            found = extract(list(page), same_host=bool(key[0]))
            ids, urls, texts = [r[0] for r in group], [r[1] for r in group], [found[r[2]] for r in group]
            group.clear()
            page.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        for b in batches:
            for *of, i, url, html in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if group and key != of:
                    yield done()
                key = of
                group.append((i, url, page.setdefault(html or "", len(page))))
        if group:
            yield done()

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
