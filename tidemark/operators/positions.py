"""Log positions: gaps, durable positions, low-watermarks, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import last_known, suffix_min

OPEN_END = (1 << 63) - 1


def sequence_gaps(logs: DataFrame) -> DataFrame:
    """``(thread, after_sequence, next_sequence)`` wherever a thread's sequence numbers jump."""
    before = F.lag("sequence").over(Window.partitionBy("thread").orderBy("sequence"))
    seen = logs.select("thread", "sequence").distinct().withColumn("after_sequence", before)
    jump = F.col("sequence") != F.col("after_sequence") + 1
    return seen.where(jump).select("thread", "after_sequence", F.col("sequence").alias("next_sequence"))


def durable_positions(records: DataFrame) -> DataFrame:
    """``(thread, sequence, lwn, durable_scn)``: the last position of each durable unit."""
    return records.groupBy("thread", "sequence", "lwn").agg(F.max("scn").alias("durable_scn"))


def low_watermarks(durable: DataFrame, txns: DataFrame, width: int | None = None) -> DataFrame:
    """``durable`` with ``low_watermark``: the least first SCN of transactions open at that position.

    A transaction is open at d if first_scn <= d < end_scn, or for good if its outcome is OPEN. Of
    the transactions that end after d the least first SCN decides: it is open at d if it isn't after d.
    """
    ends = F.when(F.col("outcome") == "OPEN", F.lit(OPEN_END)).otherwise(F.col("end_scn"))
    never = txns.where("outcome = 'OPEN'").agg(F.min("first_scn").alias("open_first"))
    events = txns.where("outcome <> 'OPEN'").select(ends.alias("p"), F.lit(0).alias("k"), "first_scn")
    marks = durable.select(F.col("durable_scn").alias("p"), F.lit(1).alias("k"), *durable.columns)
    both = events.unionByName(marks, allowMissingColumns=True)
    # at the same position the mark comes first from above: the transaction has ended there
    low = suffix_min(both, "p", "first_scn", "low", width, tie="k").where("k = 1").crossJoin(F.broadcast(never))  # one row
    low = low.withColumn("low", F.least("low", "open_first"))
    return low.select(*durable.columns, F.when(F.col("low") <= F.col("durable_scn"), F.col("low")).alias("low_watermark"))


def archive_for(archives: DataFrame, scns: DataFrame, width: int | None = None) -> DataFrame:
    """``(scn, sequence)``: for each position the latest archive that starts at or before it.

    ``archives`` has ``sequence, first_scn``; of several that start at the same position the highest
    sequence is the latest. A null position, and one before all archives, has none. Archives without
    a start count for nothing. Both sides are merged by position, so no range join is needed.
    """
    none = F.lit(None).cast("long")
    points = archives.where("first_scn is not null").select(F.col("first_scn").alias("p"), F.lit(0).alias("k"), F.col("sequence").cast("long").alias("sequence"), none.alias("scn"))
    asked = scns.select(F.col("scn").alias("p"), F.lit(1).alias("k"), none.alias("sequence"), F.col("scn").cast("long").alias("scn"))
    both = points.unionByName(asked.where("p is not null"))
    found = last_known(both, [], ["p", "k", "sequence"], {"found": F.col("sequence")}, width).where("k = 1")
    return found.select("scn", F.col("found").alias("sequence")).union(asked.where("p is null").select("scn", "sequence"))


def earliest_archive(archives: DataFrame) -> DataFrame:
    """``(thread, sequence, first_scn)`` of each thread's earliest archive, from which a dictionary can be replayed."""
    first = archives.where("first_scn is not null").groupBy("thread").agg(F.min(F.struct("first_scn", "sequence")).alias("a"))
    return first.select("thread", "a.sequence", "a.first_scn")


def start_position(stored: int | None, configured: int | None, current: int) -> int:
    """Where capture starts: the stored position, else the configured one, else the current one.

    A configured position after a stored one would skip data and is refused.
    """
    if stored is not None and configured is not None and configured > stored:
        raise ValueError(f"start position {configured} lies after the stored position {stored}; going forward would lose changes")
    return next(x for x in (stored, configured, current) if x is not None)


def rewind_target(target: int, safe: int) -> int:
    """``target`` if capture may go back to it; it must not lie after the safe position."""
    if target > safe:
        raise ValueError(f"cannot rewind to {target}: only positions up to {safe} are durable")
    return target


def from_position(records: DataFrame, start: int) -> DataFrame:
    """Records from ``start`` on. Transactions that began before come in part: see ``begun_before``."""
    return records.where(F.col("scn") >= start)


def begun_before(records: DataFrame, start: int) -> DataFrame:
    """``(container, xid)`` of transactions with records on both sides of ``start``."""
    spans = records.groupBy("container", "xid").agg(F.min("scn").alias("a"), F.max("scn").alias("b"))
    return spans.where((F.col("a") < start) & (F.col("b") >= start)).select("container", "xid")
