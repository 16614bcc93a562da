"""Ordered computations without a single-partition window.

Rows are cut into ranges of an ordering key; one row for each range carries what the ranges before
it add up to, and a window inside each range does the rest. Only the rows for ranges ever meet in
one partition. Ranges come from the data: quantiles of the key cut it so that each holds about
``ROWS`` rows, whether keys are dense, sparse or uneven. ``width`` fixes the keys of a range instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should hold, and how many ranges there are at most.
ROWS, RANGES = 1 << 20, 4096


def cuts(df: DataFrame, key: str) -> list[int]:
    """The least keys of all ranges but the first."""
    parts = min(RANGES, -(-df.where(F.col(key).isNotNull()).count() // ROWS))
    if parts <= 1:
        return []
    shares = ", ".join(f"{i / parts}d" for i in range(1, parts))
    return sorted(set(df.agg(F.expr(f"percentile_approx(`{key}`, array({shares}), {4 * RANGES})")).first()[0]))


def range_of(key: Column, least: Sequence[int]) -> Column:
    """How many of the sorted ``least`` are not above ``key``, by halving; null for a null key."""
    if not least:
        return F.when(key.isNotNull(), F.lit(0))
    bounds = F.expr(f"array({', '.join(f'{x}L' for x in least)})")
    steps = F.expr(f"array({', '.join(str(1 << b) for b in range(len(least).bit_length() - 1, -1, -1))})")
    found = F.aggregate(steps, F.lit(0), lambda lo, p: F.when(F.get(bounds, lo + p - 1) <= key, lo + p).otherwise(lo))
    return F.when(key.isNotNull(), found)


def ranged(df: DataFrame, key: str, width: int | None) -> DataFrame:
    """``df`` with ``key_range``."""
    at = F.floor(F.col(key) / width).cast("long") if width else range_of(F.col(key), cuts(df, key)).cast("long")
    return df.withColumn("key_range", at)


def running_sum(df: DataFrame, key: str, value: Column, out: str, width: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to this one, by ``key`` and then ``ties``.

    ``key`` is a whole number and not null; rows equal in key and ties are summed together.
    """
    cut = ranged(df.withColumn("own_value", value), key, width)
    sums = cut.groupBy("key_range").agg(F.sum("own_value").alias("range_sum"))
    earlier = Window.orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key_range", F.coalesce(F.sum("range_sum").over(earlier), F.lit(0)).alias("before_range"))
    inside = Window.partitionBy("key_range").orderBy(key, *ties)
    cut = cut.join(sums, "key_range")
    return cut.withColumn(out, F.col("before_range") + F.sum("own_value").over(inside)).drop("key_range", "before_range", "own_value")


def dense_rank(df: DataFrame, key: str, out: str, width: int | None = None) -> DataFrame:
    """``df`` with the dense rank of ``key``, from 1."""
    keys = running_sum(df.select(key).distinct(), key, F.lit(1), out, width)
    return df.join(keys, key)


def suffix_min(df: DataFrame, key: str, value: str, out: str, width: int | None = None, tie: str | None = None) -> DataFrame:
    """``df`` with the least ``value`` over the rows from this one on, by ``key`` and then ``tie``."""
    cut = ranged(df, key, width)
    later = Window.orderBy(F.desc("key_range")).rowsBetween(Window.unboundedPreceding, -1)
    lows = cut.groupBy("key_range").agg(F.min(value).alias("range_min"))
    lows = lows.select("key_range", F.min("range_min").over(later).alias("after_range"))
    keys = [F.desc(key), *([F.desc(tie)] if tie else [])]
    inside = Window.partitionBy("key_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.join(lows, "key_range").withColumn(out, F.least(F.min(value).over(inside), "after_range"))
    return cut.drop("key_range", "after_range")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], width: int | None = None) -> DataFrame:
    """``df`` with, for each of ``values`` by its name, the last non-null one of the rows with the same
    ``keys`` up to this one in ``order``, whose first column is a whole number.

    A key however hot is cut by ranges, each range's last values are carried on by a row a key and
    range, and nothing is paired.
    """
    cut = ranged(df.withColumns({f"own {k}": v for k, v in values.items()}), order[0], width)
    at = F.struct(*order)
    ends = cut.groupBy(*keys, "key_range").agg(*[F.max_by(f"own {k}", F.when(F.col(f"own {k}").isNotNull(), at)).alias(f"end {k}") for k in values])
    before = Window.partitionBy(*keys).orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "key_range", *[F.last(f"end {k}", ignorenulls=True).over(before).alias(f"carried {k}") for k in values])
    inside = Window.partitionBy(*keys, "key_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = {k: F.coalesce(F.last(f"own {k}", ignorenulls=True).over(inside), F.col(f"carried {k}")) for k in values}
    added = [f"{x} {k}" for k in values for x in ("own", "carried")]
    return cut.join(ends, [*keys, "key_range"], "left").withColumns(known).drop("key_range", *added)
