"""Checks before and after a run: preflight, identity, comparison of outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import canonical_json


class PreflightError(RuntimeError):
    """Some check before the start failed; the message names each with its hint."""


#: Checks that a start needs: the metadata column, the value it must have, and what to do.
PREFLIGHT = (
    ("version", ("19", "26"), "use a supported database version"),
    ("log_mode", ("ARCHIVELOG",), "switch the database to ARCHIVELOG"),
    ("supplemental_log", ("YES", "IMPLICIT"), "add minimal supplemental logging"),
    ("force_logging", ("YES",), "switch FORCE LOGGING on"),
    ("paths_mapped", ("YES",), "add a path mapping for each log folder"),
    ("files_readable", ("YES",), "make the log files readable"),
    ("privileges", ("YES",), "grant the missing privileges"),
)


def preflight(metadata: DataFrame) -> DataFrame:
    """``(check, found, ok, hint)`` from the first row of ``metadata``; a missing column fails its check."""
    cells = [
        F.struct(F.lit(c).alias("check"), (F.col(c).cast("string") if c in metadata.columns else F.lit(None).cast("string")).alias("found"), F.array(*map(F.lit, ok)).alias("allowed"), F.lit(hint).alias("hint"))
        for c, ok, hint in PREFLIGHT
    ]
    rows = metadata.limit(1).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    ok = F.coalesce(F.exists("allowed", lambda a: F.col("found").startswith(a)), F.lit(False))
    return rows.select("check", "found", ok.alias("ok"), "hint")


def require(checks: DataFrame) -> None:
    """Raises ``PreflightError`` unless all checks hold."""
    bad = checks.where("not ok").collect()  # at most one row for each check
    if bad:
        raise PreflightError("; ".join(f"{r['check']} is {r['found']}: {r['hint']}" for r in bad))


def same_identity(stored: DataFrame, live: DataFrame, columns: Sequence[str] = ("dbid", "incarnation", "resetlogs")) -> bool:
    """Whether the one-row identities are equal, nulls included."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    a, b = stored.select(*columns).limit(1).alias("a"), live.select(*columns).limit(1).alias("b")
    match = on[0]
    for x in on[1:]:
        match = match & x
    return a.join(b, match).limit(1).count() == 1


def difference(mine: DataFrame, expected: DataFrame, json_columns: Sequence[str] = ()) -> DataFrame:
    """Rows that only one side has, with ``side``; repeated rows count. JSON columns compare by structure."""
    for c in json_columns:
        mine, expected = mine.withColumn(c, canonical_json(F.col(c))), expected.withColumn(c, canonical_json(F.col(c)))
    expected = expected.select(*mine.columns)
    extra = mine.exceptAll(expected).withColumn("side", F.lit("extra"))
    return extra.unionByName(expected.exceptAll(mine).withColumn("side", F.lit("missing")))
