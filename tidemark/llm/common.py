"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, checkpointed, delete, shared_folder

__all__ = ["SPACE", "Scratch", "checkpointed", "delete", "give_back", "let", "shared_folder", "table"]

#: White space between words: the space and the characters 0x09 to 0x0D.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """A worker process stays after its task; what it no longer uses goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is then evaluated once per row.

    A lambda's argument is a computed value, while a column used twice may be inlined twice.
    """
    return F.transform(F.array(value), body)[0]
