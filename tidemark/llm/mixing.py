"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. With weight w, block i of a source is released at slot
floor(i / w) and due by slot ceil((i + 1) / w); of the released blocks, earliest deadline first.
Every source is then less than one block from its share at every slot. Weights are whole numbers,
so the schedule repeats after as many slots as they add up to: one period is worked out once, and
a block's slot follows from its number by arithmetic. When a source has no block left, the others
go on with their weights in a new phase; there are at most as many phases as sources.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


#: The driver makes the schedule, a row for each source, and sends it to all tasks: so many sources, and
#: so many slots in the periods of all phases, which are as many as sources that end at different slots.
MAX_SOURCES, MAX_SLOTS = 3_000, 5_000_000


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period, which has as many slots as the weights add up to."""
    total = sum(weights.values())
    later = [(0, s, 0) for s in sorted(weights) if weights[s] > 0]  # release, source, number
    heapify(later)
    ready: list[tuple[int, str, int]] = []  # deadline, source, number
    out = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, s, i = heappop(later)
            heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        due, s, i = heappop(ready)
        assert slot < due
        out.append(s)
        heappush(later, ((i + 1) * total // weights[s], s, i + 1))
    return out


def phases(weights: Mapping[str, int], blocks: Mapping[str, int], start: int = 0) -> dict[str, list[tuple]]:
    """How a source's blocks turn into slots: ``(first, last, start, length, offsets)`` for each phase.

    Block b, first <= b <= last, has slot start + (b - first) // n * length + offsets[(b - first) % n]
    with n = len(offsets). More than ``MAX_SLOTS`` slots in all periods are an error.
    """
    slots = 0
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out: dict[str, list[tuple]] = {s: [] for s in left}
    while left:
        own = {s: weights[s] for s in left}
        slots += sum(own.values())
        if slots > MAX_SLOTS:
            raise ValueError(f"the schedule has more than {MAX_SLOTS} slots; give smaller weights or fewer sources")
        order = period(own)
        places: dict[str, list[int]] = {s: [] for s in own}
        for t, s in enumerate(order):
            places[s].append(t)
        ends = []
        for s in own:
            whole, rest = divmod(left[s] - 1, own[s])
            ends.append(whole * len(order) + places[s][rest] + 1)  # the slot after its last block
        whole, rest = divmod(min(ends), len(order))
        for s in own:
            took = whole * own[s] + bisect_left(places[s], rest)
            out[s].append((done[s], done[s] + took - 1, start, len(order), places[s]))
            done[s] += took
            left[s] -= took
        left = {s: n for s, n in left.items() if n > 0}
        start += min(ends)
    return out


def mix(docs: DataFrame, weights: Mapping[str, int], default: int = 1, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = None) -> DataFrame:
    """``docs`` with ``mix_slot`` and ``mix_place`` (long): rows ordered by these are the mixture.

    Every row stays, once. A source without a weight gets ``default``, and so does a null source,
    which is a source of its own; a source with a weight of 0 or less comes after all others. In a
    source, rows go by id, nulls first, then by a hash of ``text_col`` if given, then by hashes of
    the whole row; equal rows have places of their own side by side. A slot holds ``block_rows`` rows
    of one source, its last block perhaps fewer. An empty table gives an empty one. Columns of
    ``docs`` named like the two are replaced. More than ``MAX_SOURCES`` sources are an error.
    """
    docs = docs.drop("mix_slot", "mix_place")
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-"))
    tie = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) if text_col else F.lit(0).cast("long")
    whole = [F.col(f"`{c}`") for c in docs.columns]
    seen = [*whole, *[c.isNull() for c in whole]]  # a null alone leaves a hash as it is
    row = {"mix_row": F.xxhash64(F.lit(1), *seen), "mix_row2": F.xxhash64(F.lit(2), *seen)}
    key = {"mix_source": source, "mix_id": F.col(f"`{id_col}`"), "mix_tie": tie} | row
    keys = docs.select(*[c.alias(k) for k, c in key.items()]).groupBy(*key).agg(F.count("*").alias("n"))
    dealt = keys.repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    parts = dealt.groupBy("mix_source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = checkpointed(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    found = parts.groupBy("mix_source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources cannot be scheduled")
    counts = {r["mix_source"]: r["n"] for r in found}
    given = {s: weights.get(s[1:], default) if s != "-" else default for s in counts}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    plan = phases(given, {s: n for s, n in blocks.items() if given[s] > 0})
    end = max((p[2] + (p[1] - p[0]) // len(p[4]) * p[3] + p[3] for x in plan.values() for p in x), default=0)
    rest = {s: n for s, n in blocks.items() if given[s] <= 0}
    plan |= phases(dict.fromkeys(rest, 1), rest, end)
    schema = "mix_source string, phases array<struct<first:long,last:long,start:long,length:long,offsets:array<long>>>"
    table = docs.sparkSession.createDataFrame(list(plan.items()), schema)  # a row for each source
    inside = Window.partitionBy("mix_source", "part").orderBy("mix_id", "mix_tie", "mix_row", "mix_row2").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = ranked.join(parts.drop("n"), ["mix_source", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
    # equal rows meet as one row and their number, so that a row however often repeated is no task's group
    copies = docs.select(*[c.alias(k) for k, c in row.items()], F.struct(*whole).alias("row")).groupBy(*row).agg(F.first("row").alias("row"))
    rows = copies.join(ranked, list(row)).select("mix_source", "row", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("n") - 1)).alias("rank"))
    placed = rows.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long")).join(F.broadcast(table), "mix_source")

    def slot(p):
        since, n = F.col("block") - p["first"], F.size(p["offsets"])
        return p["start"] + F.floor(since / n) * p["length"] + F.get(p["offsets"], (since % n).cast("int"))

    at = F.transform(F.filter("phases", lambda p: (F.col("block") >= p["first"]) & (F.col("block") <= p["last"])), slot)[0]
    placed = placed.select("row", at.cast("long").alias("mix_slot"), (F.col("rank") % block_rows).cast("long").alias("mix_place"))
    return placed.select("row.*", "mix_slot", "mix_place")


def mixed_documents(docs: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """The rows of ``docs``, with its columns, sorted into the mixture's order."""
    mixed = mix(docs, weights, text_col="text")
    return mixed.orderBy("mix_slot", "mix_place").select(*[F.col(f"`{c}`") for c in docs.columns])
