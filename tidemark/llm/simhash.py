"""Near-duplicate documents by SimHash fingerprints and the generalised pigeonhole principle.

1. Each text gets a 64-bit fingerprint; only ``(id, fingerprint)`` is kept, and equal
   fingerprints become one node.
2. Correlated bits are grouped into partitions: three, or two from some 30 million fingerprints on,
   when values of a third of the bits would each be shared by many. Two fingerprints within ``tau``
   bits agree on some partition within its threshold if the thresholds sum to ``tau - parts + 1``,
   where a threshold of -1 leaves a partition out.
3. A dynamic program gives every fingerprint the thresholds with the fewest estimated candidates:
   exact counts for threshold 0, counts plus the usual density of the neighbours for threshold 1.
4. Values of a partition that many fingerprints share would give all pairs of a group. One
   partition of all 64 bits with threshold 2 covers such fingerprints: both sides list what lies
   within one bit of them, and two fingerprints within two bits meet at a common centre. Each
   centre has 65 fingerprints at most and links them to its smallest one; this needs 65 rows a
   fingerprint whatever the size of a group.
5. Candidates are verified bit by bit; components come from alternating large-star and small-star
   steps. Keys with a large share of all rows are joined by a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """A hash of each of a text's ``size``-word shingles, in order; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)],
        dtype="<u8",
    )


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of a text's ``size``-word shingles, as an unsigned integer; 0 without a word."""
    return simhash_of(shingle_hashes(text, size))


def simhash_of(hashes: np.ndarray) -> int:
    """The fingerprint of little-endian unsigned 64-bit hashes: a bit is set if over half of them have it."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, h, fp)`` of each row: a hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "h", "fp"])

    text = docs[text_col].cast("string")
    own = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return own.mapInArrow(run, "id long, h long, fp long")


def partitions_for(n: int) -> int:
    """How many partitions suit ``n`` fingerprints: three while about 16 or fewer share a value of a third of the bits."""
    return 3 if n < 16 << BITS // 3 else 2


def _bit_groups(nodes: DataFrame, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups, each grown from a bit by the bits most correlated with it.

    How often each two bits are set together is counted over all fingerprints: 64 rows of 64
    counts from each task, which Spark adds up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), dtype=np.float64)
        n = 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BITS)), pa.array([float(n)] * BITS), pa.array(both.tolist())], names=["bit", "n", "both"]
            )

    counted = nodes.select("fp").mapInArrow(count, "bit long, n double, both array<double>")
    rows = counted.groupBy("bit").agg(F.sum("n").alias("n"), *[F.sum(F.col("both")[j]).alias(f"b{j}") for j in range(BITS)]).collect()
    corr = np.zeros((BITS, BITS))
    if rows:
        n = rows[0]["n"]
        joint = np.array([[r[f"b{j}"] for j in range(BITS)] for r in sorted(rows, key=lambda r: r["bit"])]) / n
        p = np.diag(joint)
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        corr = np.abs((joint - np.outer(p, p)) / np.outer(sd, sd))
        np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for g in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - g)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> 63 else m


def _flip(fp: Column, bit: int) -> Column:
    return fp.bitwiseXOR(F.lit(_mask([bit])))


def _allocate(counts: list[Column], widths: list[int], density: list[float], total: int) -> Column:
    """The thresholds, by a dynamic program over partitions and what is left of their sum.

    A state holds the cost so far and the thresholds chosen; ``least`` over structs takes the
    cheaper of two ways into a state.
    """
    states: dict[int, Column] = {0: F.struct(F.lit(0.0).alias("cost"), F.lit("").alias("t"))}
    for i, c in enumerate(counts):
        steps = {-1: F.lit(0.0), 0: c + F.lit(1.0), 1: c + F.lit(widths[i] * (1 + density[i]) + 1.0)}
        new: dict[int, list[Column]] = {}
        for s, before in states.items():
            for t, cost in steps.items():
                new.setdefault(s + t, []).append(
                    F.struct((before["cost"] + cost).alias("cost"), F.concat(before["t"], F.lit("-01"[t + 1])).alias("t"))
                )
        states = {s: F.least(*ways) if len(ways) > 1 else ways[0] for s, ways in new.items()}
    return states[total]


def _signatures(fp: Column, t: Column, part: int, bits: list[int]) -> Column:
    """``(part, value)`` of every value of a partition within the threshold ``t``, none for ``-``."""
    value = fp.bitwiseAND(F.lit(_mask(bits)))
    within = F.when(t == "-", F.array().cast("array<bigint>")).when(t == "0", F.array(value)).otherwise(F.array(value, *[_flip(value, b) for b in bits]))
    return F.transform(within, lambda v: F.struct(F.lit(part).alias("part"), v.alias("value")))


def links(nodes: DataFrame, tau: int = 2, hot: int = BITS, parts: int | None = None) -> DataFrame:
    """Edges ``(a, b)``, a > b, that join every two distinct ``fp`` of ``nodes`` within ``tau`` = 2 bits.

    Fingerprints in large groups are joined through their centre's smallest member, so the edges
    have the same components as all links, not each link itself. ``hot``: from so many
    fingerprints that share a partition's value on, they are linked by centres. ``parts``: how many
    partitions the bits are cut into, by default as ``partitions_for`` tells.
    """
    if tau != 2:
        raise ValueError("centres one bit away cover two differing bits")
    total = nodes.count()
    parts = parts or partitions_for(total)
    groups = _bit_groups(nodes, parts)
    masks, widths = [_mask(g) for g in groups], [len(g) for g in groups]
    fp = F.col("fp")
    sides = nodes.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m)) for m in masks])).alias("part", "value"))
    counts = sides.groupBy("part", "value").agg(F.count("*").alias("c"))
    counts = checkpointed(counts)
    seen = {r["part"]: r for r in counts.groupBy("part").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("share"), F.sum("c").alias("n")).collect()}
    # what a flipped value meets: the density of values as fingerprints see it
    density = [seen[i]["share"] - 1 if i in seen else 0.0 for i in range(parts)]
    shared = counts.where("c > 1").withColumn("n", F.col("c"))  # a value of one fingerprint alone has nothing to look up
    sided = _joined(sides, shared, ["part", "value"], total)
    known = sided.groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("c") - 1)).alias(f"c{i}") for i in range(parts)])
    counted = nodes.select("fp").join(known, "fp", "left").select("fp", *[F.coalesce(f"c{i}", F.lit(0)).cast("double").alias(f"c{i}") for i in range(parts)])
    plan = _allocate([F.col(f"c{i}") for i in range(parts)], widths, density, tau - parts + 1)
    most = F.greatest(*[F.col(f"c{i}") for i in range(parts)])
    planned = checkpointed(counted.withColumn("plan", plan).select("fp", most.alias("most"), F.col("plan.cost").alias("cost"), F.col("plan.t").alias("t")))
    probing = planned.where(f"cost <= {BITS + 1} and most < {hot}")
    signatures = F.flatten(F.array(*[_signatures(fp, F.substring("t", i + 1, 1), i, groups[i]) for i in range(parts)]))
    probes = probing.select("fp", F.explode(signatures).alias("s")).select("fp", "s.part", "s.value")
    # only values that exist
    looked = checkpointed(_joined(probes, counts.withColumn("n", F.col("c")), ["part", "value"], total))
    hottest = counts.where(f"c > {hot} and c * 2000 > {total}").select("part", "value")  # few; their rows take no way to one task
    index = sides.join(F.broadcast(hottest), ["part", "value"], "left_anti").select(F.col("fp").alias("other"), "part", "value")
    pairs = (
        looked.where(f"c <= {hot}").join(index, ["part", "value"])
        .where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau))
        .select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
    )
    by_centre = (
        planned.where(f"not (cost <= {BITS + 1} and most < {hot})").select("fp").union(looked.where(f"c > {hot}").select("fp")).distinct()
    )
    centres = by_centre.select("fp", F.explode(F.array(fp, *[_flip(fp, b) for b in range(BITS)])).alias("centre"))
    met = centres.groupBy("centre").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    stars = met.select(F.explode("met").alias("a"), F.array_min("met").alias("b")).where("a != b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of each node in an edge ``(a, b)`` but the roots; a component's root is its smallest node.

    Large-star hangs each larger neighbour on a node's smallest one, small-star each smaller one;
    both until nothing changes. Minima are taken in part before the shuffle and joined back; those of
    nodes with many neighbours, fewer than 4,000, by a broadcast, so no node is one task's group.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    while mark["n"]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        few = mark["n"] < LIGHT
        large = (both.join(low.drop("n"), "u") if few else _joined(both, low, ["u"], mark["n"])).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = large if few else checkpointed(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (large.join(low.drop("n"), "a") if few else _joined(large, low, ["a"], mark["n"])).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        new = checkpointed(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct())
        found = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now, done, mark = new, found == mark, found
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: So few edges are no load for a task, even if all have one node.
LIGHT = 200_000


def _joined(rows: DataFrame, table: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` with the one row of ``table`` for their ``key``; ``n`` there is how many rows have the key.

    Keys with over a 2000th of ``total`` rows are few and joined by a broadcast, so no key is one task's.
    """
    is_hot = F.col("n") * 2000 > total
    hot, rest = table.where(is_hot).drop("n"), table.where(~is_hot).drop("n")
    others = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(rest, key))


def grouped(fps: DataFrame, tau: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(fp, root, n)`` of each distinct fingerprint in ``fps`` (``id, h, fp``), and ``(root, best, n)`` of each component.

    ``root`` is the component's smallest fingerprint, ``best`` its least ``(no_id, id, h)``: the
    smallest id, nulls last, and the smallest hash with it. ``n`` counts rows and fingerprints.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("best")
    nodes = checkpointed(fps.groupBy("fp").agg(first, F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), tau))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "best", "n")
    lowest = named.groupBy("root").agg(F.min("best").alias("best"), F.count("*").alias("n"))
    return named.select("fp", "root", "n"), lowest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, tau: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows with equal
    texts are one node. ``component_id`` is the smallest non-null id reachable, null if there is
    none. Other columns of ``docs``, whatever their names, are not read.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, size))
    named, lowest = grouped(fps, tau)
    named, lowest = checkpointed(named), checkpointed(lowest.select("root", F.col("best.id").alias("component_id"), "n"))
    known = checkpointed(_joined(named.withColumnRenamed("n", "rows"), lowest, ["root"], named.count()).select("fp", "component_id", F.col("rows").alias("n")))
    rows = _joined(fps.select("id", "fp"), known, ["fp"], fps.count())
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, tau: int = 2) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, nulls last, and of rows
    with that id the one whose text has the smallest hash. Columns are those of ``docs``."""
    _, lowest = grouped(checkpointed(fingerprints(docs, id_col, text_col, size)), tau)
    return first_of_each(docs, lowest, id_col, text_col)


def first_of_each(docs: DataFrame, lowest: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``best`` in ``lowest`` (``no_id, id, h``) names, one of equal ones."""
    id_type = docs.schema[id_col].dataType

    def key(i: Column, h: Column) -> dict[str, Column]:
        return {"key no id": i.isNull(), "key id": F.coalesce(i, F.lit(0)), "key hash": h}

    ones = lowest.select(*[c.alias(k) for k, c in key(F.col("best.id"), F.col("best.h")).items()])
    keyed = docs.withColumns(key(docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))))
    # one shuffle serves both: equal rows come in copies, of which one stays
    kept = keyed.join(ones, ones.columns, "left_semi").dropDuplicates(ones.columns)
    return kept.select(*[F.col(f"`{c}`") if c != id_col else F.col(f"`{c}`").cast(id_type) for c in docs.columns])
