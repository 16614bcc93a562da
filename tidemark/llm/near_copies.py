"""Near copies of texts: a Jaccard similarity of 0.8 or more of their sets of five-word shingles.

1. Texts with equal shingle sets become one node.
2. SimHash fingerprints of the sets within two bits, found by the generalised pigeonhole, are the
   first candidates. Sets of that similarity differ by some ten bits of 64, often by over 15, and no
   partition of 64 bits finds those without looking at most pairs; so the others come in another way:
3. Two sets of that similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, in
   any order that holds for all. Rare shingles come first: those that a sample shows often are put
   last, so a common passage is in no prefix of a text that has enough else. The sample changes
   the work, not the result.
4. Texts that share a prefix's shingle are candidates. Neighbours by size are compared first and,
   where more than ``HOT`` texts share it, neighbours in a few random orders. That joins most of a
   group; then every pair that still lies in different components is compared. Pairs within a
   component need no look, and of two texts in different ones at least one is outside of the
   component that most texts of the shingle are in. Of the shingles that two similar sets share,
   the first in order stands so early in both that what follows it can still be enough; pairs are
   taken only from shingles that stand so.
5. Where more than ``LARGE`` texts share a shingle, the text with the fewest shingles before it is
   their hub, and what each has in common with the hub is counted. That joins copies with few edits.
   Two texts whose first common shingle it is differ by all that stands before it in both and, from
   there on, by no less than their distances from the hub do. So copies with many edits of their
   own, which are far from the hub and from each other, are no candidates: places and distances
   are compared first, once for all texts that have the same, then texts.
6. A bitmap of each set, a bit a shingle at most, holds the parity of how many shingles fall on a
   bit. Two sets differ by as many shingles as their bitmaps by bits, or more: that rules most
   candidates out. The rest are verified on the whole sets. A group is a component of verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, give_back
from .simhash import components, first_of_each, links, shingle_hashes, simhash_of

SIZE, HOT, ORDERS, LARGE = 5, 16, 4, 64
#: The sample that shows frequent shingles: texts, how many of them must have one, and how many shingles are taken.
SAMPLE, OFTEN, MOST = 5_000, 4, 50_000
#: So many texts to verify, 16 bytes each, are named to all tasks; of more, the texts are shuffled.
NAMED = 1_000_000
#: So many shingles, 8 bytes each, or so many rows make a batch that goes back to Spark; a text is never cut.
BATCH, BATCH_ROWS = 1 << 17, 4_096


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; a text of fewer words is one shingle, one without a word has none."""
    return np.unique(shingle_hashes(text, SIZE)).view(np.int64)


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 5)).astype(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of shingles, as longs: a power of two of bits, 64 or as many as shingles at least.

    Half as many bits result from the XOR of its halves.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount(s & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _batched(rows: Iterable[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of ``rows``, whose last value is an array; a batch ends when these hold ``BATCH`` values."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))

    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= BATCH or len(held) >= BATCH_ROWS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _sets(own: DataFrame) -> DataFrame:
    """``(node, shingles)`` of each row."""
    kinds = {"node": pa.int64(), "shingles": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (shingles(t.as_py()) for b in batches for t in b.column("text"))
        yield from _batched(((_node(s), s) for s in sets), kinds)
        give_back()

    return own.mapInArrow(run, "node long, shingles array<long>")


def _frequent(own: DataFrame) -> np.ndarray:
    """Shingles that many texts of a sample have, the most frequent last."""
    every = max(8, own.count() // SAMPLE)
    found = _sets(own.where(F.pmod("h", F.lit(every)) == 0)).select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= OFTEN)
    rows = found.orderBy(F.desc("count"), "s").limit(MOST).collect()
    return np.array([r["s"] for r in reversed(rows)], dtype=np.int64)


def _nodes(own: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(node, best, n, fp, parity, prefix)``; ``best`` is the node's least ``(no_id, id, h)``, ``n`` its
    set's size, ``fp`` its fingerprint."""
    by_value = np.argsort(frequent)
    known = frequent[by_value]
    names = ["id", "h", "node", "n", "fp", "parity", "prefix"]
    kinds = dict(zip(names, [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2, strict=True))

    def row(i: int | None, h: int, text: str | None) -> tuple:
        s = shingles(text)
        at = np.searchsorted(known, s)
        often = np.zeros(len(s), dtype=bool)
        inside = at < len(known)
        often[inside] = known[at[inside]] == s[inside]
        places = np.sort(by_value[at[often]])
        prefix = np.concatenate((s[~often], frequent[places]))[: len(s) - -(-4 * len(s) // 5) + 1]
        fp = int(np.uint64(simhash_of(s.view("<u8"))).astype(np.int64))
        return i, h, _node(s), len(s), fp, parity(s), prefix.copy()  # a slice would hold the whole set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(*(x.as_py() for x in values)) for b in batches for values in zip(*b.columns, strict=True))
        yield from _batched(rows, kinds)
        give_back()

    found = own.mapInArrow(run, "id long, h long, node long, n long, fp long, parity array<long>, prefix array<long>")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("best")
    return found.groupBy("node").agg(best, *[F.first(c).alias(c) for c in names[3:]])


def _fit(n: str, m: str) -> Column:
    """Sizes that let two sets be similar enough."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that sizes and bitmaps do not rule out; sizes that fit have bitmaps of one length or of double that."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    words = F.least(F.size("pa"), F.size("pb"))

    def folded(p: str) -> Column:
        halves = F.zip_with(F.slice(p, 1, words), F.slice(p, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(p) > words, halves).otherwise(F.col(p))

    apart = F.aggregate(F.zip_with(folded("pa"), folded("pb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    return pairs.join(left, "a").join(right, "b").where(_fit("na", "nb") & (9 * apart <= F.col("na") + F.col("nb"))).select("a", "b")


def _common(pairs: DataFrame, own: DataFrame, nodes: DataFrame, only: str = "true") -> DataFrame:
    """``(a, b, common)`` of distinct ``pairs``: how many shingles both have; ``only`` may use their sizes ``na`` and ``nb``, too."""
    scratch = Scratch(own.sparkSession)
    pairs = scratch.store("pairs", pairs)
    looked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ones = scratch.store("ones", nodes.join(looked, "node", "left_semi").select(F.col("best.no_id").alias("no_id"), F.coalesce("best.id", F.lit(0)).alias("one_id"), F.col("best.h").alias("h")))
    keyed = own.select(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("one_id"), "h", "text")
    few = ones.count() <= NAMED
    found = keyed.join(F.broadcast(ones) if few else ones, ones.columns, "left_semi").dropDuplicates(ones.columns)
    sets = scratch.store("sets", _sets(found))
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    out = checkpointed(counted.where(only).select("a", "b", "common"))
    scratch.clear()
    return out


#: Sets of sizes ``na`` and ``nb`` are similar enough.
SIMILAR = "9 * common >= 4 * (na + nb)"


def _verified(pairs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of distinct ``pairs`` that are similar enough."""
    return _common(_possible(pairs, nodes), own, nodes, SIMILAR).select("a", "b")


def _neighbours(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Pairs that stand side by side among a shingle's nodes, if their sizes fit."""
    w = Window.partitionBy("s").orderBy(*order, "node")
    beside = rows.withColumns({"other": F.lag("node").over(w), "m": F.lag("n").over(w)})
    return beside.where(F.col("other").isNotNull() & _fit("n", "m")).select(*_pair("node", "other")).distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints are equal or within two bits; of equal ones, with the smallest node."""
    first = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").where("node != first").select(*_pair("node", "first"))
    left, right = first.toDF("a", "first_a"), first.toDF("b", "first_b")
    near = links(first.select("fp")).join(left, "a").join(right, "b").select(*_pair("first_a", "first_b"))
    return same.union(near)


def _split(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of shingles whose nodes aren't of one component, with their ``root`` and that of ``most`` nodes."""
    named = rows.join(roots, "node", "left").select("node", "n", "i", "s", "c", F.coalesce("root", "node").alias("root"))
    of_root = named.groupBy("s", "root").count()
    split = of_root.groupBy("s").agg(F.max(F.struct("count", "root"))["root"].alias("most"), F.count("*").alias("roots")).where("roots > 1").select("s", "most")
    return named.join(split, "s")


def _roots(own: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of the nodes that are in a group of more than one."""
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("i", "s"))
    shared = scratch.store("shared", rows.withColumn("c", F.count("*").over(Window.partitionBy("s"))).where("c > 1"))
    # by size, so a node that fits no neighbour fits no other
    pairs = scratch.store("pairs", _neighbours(shared, "n").union(_by_fingerprint(nodes)).distinct())
    edges = _verified(pairs, own, nodes)
    left = scratch.store("left", _split(shared, components(edges)))
    scratch.drop("shared")
    mixed = _neighbours(left.where(f"c > {HOT}"), F.xxhash64("node", F.pmod("s", F.lit(ORDERS))))
    edges = edges.union(_verified(mixed.join(pairs, ["a", "b"], "left_anti"), own, nodes))
    hubs = scratch.store("hubs", left.where(f"c > {LARGE}").groupBy("s").agg(F.min(F.struct("i", "node", "n")).alias("hub")).select("s", F.col("hub.node").alias("hub"), F.col("hub.i").alias("hub_i"), F.col("hub.n").alias("hub_n")))
    stars = _common(_stars(left, hubs), own, nodes)
    sizes = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab"]
    edges = edges.union(stars.join(sizes[0], "a").join(sizes[1], "b").where(SIMILAR).select("a", "b"))
    apart = scratch.store("apart", _placed(_split(left.drop("root", "most"), components(edges)), hubs, stars))
    scratch.drop("left")
    cross = _cross(apart, scratch)
    return components(edges.union(_verified(cross.join(pairs, ["a", "b"], "left_anti"), own, nodes)))


def _stars(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs of a shingle's nodes with its hub, if their sizes fit."""
    return rows.join(hubs, "s").where((F.col("node") != F.col("hub")) & _fit("n", "hub_n")).select(*_pair("node", "hub")).distinct()


def _placed(rows: DataFrame, hubs: DataFrame, stars: DataFrame) -> DataFrame:
    """``rows`` with ``low`` and ``high``: from their shingle on, a node's set and the hub's differ by so many.

    Both are null where there is no hub or its size does not fit. What the hub has before the shingle
    may be in the node's set or not, so the two differ by up to twice that.
    """
    both = stars.select(F.col("a").alias("node"), F.col("b").alias("hub"), "common").union(stars.select("b", "a", "common"))
    far = rows.join(hubs, "s", "left").join(both, ["node", "hub"], "left")
    common = F.when(F.col("node") == F.col("hub"), F.col("n")).otherwise(F.col("common"))
    low = F.col("n") - F.col("i") + F.col("hub_n") - F.col("hub_i") - 2 * common
    return far.select("s", "node", "n", "i", "root", "most", "c", low.alias("low"), (low + 2 * F.least("i", "hub_i")).alias("high"))


#: Of a row: what tells, with that of another row, whether the two may be similar.
PLACE = ["n", "i", "low", "high"]


def _may_be_similar() -> Column:
    """Sets whose first common shingle stands at ``i`` and ``other_i`` have too few differences that are certain to rule them out."""
    fewest = F.greatest(F.lit(0), F.col("low") - F.col("other_high"), F.col("other_low") - F.col("high"))
    rest = F.greatest(F.abs(F.col("n") - F.col("i") - F.col("other_n") + F.col("other_i")), F.coalesce(fewest, F.lit(0)))
    return _fit("n", "other_n") & (9 * (F.col("i") + F.col("other_i") + rest) <= F.col("n") + F.col("other_n"))


def _cross(apart: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs of a shingle's nodes that are in different components and may be similar.

    In large groups places are paired first: there are few of them, however many nodes have one.
    """
    apart = apart.withColumn("place", F.xxhash64(*PLACE))
    others = apart.where("root != most").select("s", *[F.col(c).alias(f"other_{c}") for c in ["node", "root", "place", *PLACE]])
    few = apart.where(f"c <= {LARGE}").join(others, "s").where(_may_be_similar())
    large = apart.where(f"c > {LARGE}")
    places = large.select("s", "place", *PLACE).distinct()
    other_places = others.select("s", *[c for c in others.columns if c.startswith("other_") and c not in ("other_node", "other_root")]).distinct()
    fit = scratch.store("fit", places.join(other_places, "s").where(_may_be_similar()).select("s", "place", "other_place"))
    many = large.join(fit, ["s", "place"]).join(others.select("s", "other_place", "other_node", "other_root"), ["s", "other_place"])
    found = [x.where("root != other_root").select(*_pair("node", "other_node")) for x in (few, many)]
    return found[0].union(found[1]).distinct()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies in ``docs``: that with the smallest id, nulls last, and of
    rows with that id the one whose text has the smallest hash. Columns are those of ``docs``.

    Null, empty and wordless texts have the empty set and are one group. Equal rows are one. An empty
    table gives an empty one.
    """
    own = _own(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    nodes = scratch.store("nodes", _nodes(own, _frequent(own)))
    roots = _roots(own, nodes, scratch)
    named = nodes.select("node", "best").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    lowest = checkpointed(named.groupBy("root").agg(F.min("best").alias("best")))
    scratch.clear()
    return first_of_each(docs, lowest, id_col, text_col)
