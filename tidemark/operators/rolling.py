"""Files of bounded size out of ordered messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .order import ranged, running_sum


def files(rows: DataFrame, order: str, size: str, limit: int, width: int | None = None) -> DataFrame:
    """``rows`` with ``file_no`` from 1: a file ends with the message that brings it to ``limit``.

    The counter starts anew in each file, so a file's end depends on its start. For every row
    the start of the file after one that began here follows from running sums. The starts that are
    really reached from the first row are found by doubling: a set of starts is joined with
    pointers that go 1, 2, 4, ... files on, and each round doubles both. ``order`` is a unique whole
    number; sizes are not negative.
    """
    summed = running_sum(rows.select(order, F.col(size).cast("long").alias("own")), order, F.col("own"), "to", width)
    # ranges of whole limits bring a start and the end of its file into neighbouring ranges
    points = summed.select(F.col("to").alias("at"), F.lit(1).alias("side"), F.col(order).alias("end"), F.lit(None).cast("long").alias("start"))
    starts = summed.select((F.col("to") - F.col("own") + limit).alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("end"), F.col(order).alias("start"))
    both = points.unionByName(starts).withColumn("r", F.floor(F.col("at") / limit).cast("long"))
    first = both.groupBy("r").agg(F.min(F.when(F.col("side") == 1, F.struct("at", "end"))).alias("f"))
    later = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("r", F.last("f", ignorenulls=True).over(later).alias("after"))
    # ends at equal sums (messages of size 0): the first of them closes the file
    inside = Window.partitionBy("r").orderBy(F.desc("at"), F.desc("side"), F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    ended = both.join(first, "r").withColumn("end", F.coalesce(F.last("end", ignorenulls=True).over(inside), "after.end"))
    ended = ended.where("side = 0").select("start", "end")
    following = _followers(summed.select(order), order, width)
    hop = ended.join(following, ended.end == following[order]).select("start", F.col("next").alias("to")).where("to is not null")
    reached = summed.agg(F.min(order).alias("start")).where("start is not null")
    hop = checkpointed(hop)
    found = reached.count()
    while True:
        more = reached.join(hop, "start").select(F.col("to").alias("start"))
        both_now = checkpointed(reached.union(more).distinct())
        n = both_now.count()
        if n == found:
            break
        reached, found = both_now, n
        ahead = hop.select(F.col("start").alias("to"), F.col("to").alias("further"))
        hop = checkpointed(hop.join(ahead, "to").select("start", F.col("further").alias("to")))
    marks = summed.select(order).join(reached.select(F.col("start").alias(order), F.lit(1).alias("first")), order, "left")
    numbered = running_sum(marks, order, F.coalesce("first", F.lit(0)), "file_no", width)
    return rows.join(numbered.select(order, F.col("file_no").cast("long").alias("file_no")), order)


def _followers(rows: DataFrame, order: str, width: int | None) -> DataFrame:
    """``(order, next)``: the value after each, null for the last."""
    cut = ranged(rows, order, width).withColumnRenamed("key_range", "r")
    lows = cut.groupBy("r").agg(F.min(order).alias("low"))
    lows = lows.select("r", F.lead("low").over(Window.orderBy("r")).alias("after"))
    inside = Window.partitionBy("r").orderBy(order)
    return cut.join(lows, "r").select(order, F.coalesce(F.lead(order).over(inside), "after").alias("next"))


def file_name(number: Column, prefix: str = "changes") -> Column:
    """Such as ``changes-000001.jsonl``."""
    return F.format_string(prefix + "-%06d.jsonl", number)
