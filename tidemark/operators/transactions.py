"""Transactions out of interleaved change records.

Records have at least ``container, xid, scn, op``; a transaction is keyed by container and xid.
``op`` is one of INSERT, UPDATE, DELETE, DDL, SAVEPOINT_RB, COMMIT, ROLLBACK.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import dense_rank

KEY = ("container", "xid")
TERMINAL = ("COMMIT", "ROLLBACK")
CHANGES = ("INSERT", "UPDATE", "DELETE", "DDL")


def outcomes(records: DataFrame) -> DataFrame:
    """``(container, xid, first_scn, end_scn, n_records, outcome)``: COMMIT, ROLLBACK or OPEN.

    ``end_scn`` is the last record's; only counts and extremes are shuffled.
    """
    last = F.max_by("op", "scn")
    return records.groupBy(*KEY).agg(
        F.min("scn").alias("first_scn"),
        F.max("scn").alias("end_scn"),
        F.count("*").alias("n_records"),
        F.when(last.isin(*TERMINAL), last).otherwise("OPEN").alias("outcome"),
    )


def without_undone(records: DataFrame) -> DataFrame:
    """Changes that no rollback to a savepoint undoes.

    A savepoint rollback at ``scn`` undoes its transaction's changes after ``savepoint_scn`` and before
    itself. For each change the least savepoint of later rollbacks decides, so one window
    by transaction replaces a range join.
    """
    later = Window.partitionBy(*KEY).orderBy(F.desc("scn")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.min(F.when(F.col("op") == "SAVEPOINT_RB", F.col("savepoint_scn"))).over(later)
    marked = records.withColumn("undone_from", reach)
    live = F.col("undone_from").isNull() | (F.col("undone_from") >= F.col("scn"))
    return marked.where(F.col("op").isin(*CHANGES) & live).drop("undone_from")


def _commits(records: DataFrame) -> DataFrame:
    return outcomes(records).where("outcome = 'COMMIT'").select(*KEY, F.col("end_scn").alias("commit_scn"))


def committed(records: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Live changes of committed transactions, with ``commit_scn`` and ``pos``, their place in the
    transaction from 1. ``commits``: a row for each of these, with further columns to carry."""
    done = _commits(records) if commits is None else commits
    place = Window.partitionBy(*KEY).orderBy("scn", "block_offset")
    return without_undone(records).join(done, list(KEY)).withColumn("pos", F.row_number().over(place).cast("long"))


def in_commit_order(records: DataFrame, width: int | None = None) -> DataFrame:
    """``committed`` with ``commit_rank``; sort by ``(commit_rank, container, xid, pos)`` for delivery.

    Transactions are ranked, a row for each, so a large one is no hot key. Those of which nothing is
    left to deliver, as all was undone, have no rank.
    """
    commits = _commits(records).join(without_undone(records).select(*KEY).distinct(), list(KEY), "left_semi")
    return committed(records, dense_rank(commits, "commit_scn", "commit_rank", width))


def messages(changes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """A begin, each change and a commit as rows of ``kind, commit_scn, container, xid, pos, op`` and, for changes, ``carry``.

    ``kind`` of a change is ``ddl`` or ``dml``; ``pos`` is 0 for begin and one past the last change for commit.
    The first change brings the begin along and the last one the commit, so changes are computed once.
    """
    whole = Window.partitionBy(*KEY)
    at = whole.orderBy("pos")
    placed = changes.withColumns({"is_first": F.lag("pos").over(at).isNull(), "is_last": F.lead("pos").over(at).isNull(), "end": F.max("commit_scn").over(whole)})
    kind = F.when(F.col("op") == "DDL", "ddl").otherwise("dml")
    given = {"op": F.col("op")} | {c: F.col(c) for c in carry}

    def message(kind: Column, pos: Column, own: bool) -> Column:
        values = [v if own else F.lit(None).cast(changes.schema[k].dataType) for k, v in given.items()]
        scn = F.col("commit_scn" if own else "end")
        return F.struct(kind.alias("kind"), scn.alias("commit_scn"), pos.cast("long").alias("pos"), *[v.alias(k) for k, v in zip(given, values, strict=True)])

    begin, own, commit = message(F.lit("begin"), F.lit(0), False), message(kind, F.col("pos"), True), message(F.lit("commit"), F.col("pos") + 1, False)
    some = F.array_compact(F.array(F.when(F.col("is_first"), begin), own, F.when(F.col("is_last"), commit)))
    rows = placed.select(*KEY, F.explode(some).alias("m"))
    return rows.select("m.kind", "m.commit_scn", *KEY, "m.pos", *[f"m.{k}" for k in given])


def with_heartbeat(rows: DataFrame, position: DataFrame, on: bool) -> DataFrame:
    """``rows`` of messages and, if ``on``, a ``chkpt`` message at each row of ``position`` (``scn``)."""
    if not on:
        return rows
    return rows.unionByName(position.select(F.lit("chkpt").alias("kind"), F.col("scn").alias("commit_scn")), allowMissingColumns=True)


def complete(rows: DataFrame) -> DataFrame:
    """Messages of transactions whose commit message is there: a consumer's view of a cut file."""
    whole = rows.where("kind = 'commit'").select(*KEY).distinct()
    return rows.join(whole, list(KEY), "left_semi")


def once(rows: DataFrame) -> DataFrame:
    """Messages without the repeats that a replay brings, by transaction, commit position and place."""
    return rows.dropDuplicates([*KEY, "commit_scn", "pos", "kind"])


def sizes(records: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """``(container, xid, n_rows, n_bytes, spills)`` of the changes of each transaction."""
    data = F.octet_length(F.coalesce(F.col("after"), F.lit(""))) + F.octet_length(F.coalesce(F.col("before"), F.lit("")))
    summed = records.where(F.col("op").isin(*CHANGES)).groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.sum(data.cast("long")).alias("n_bytes"))
    return summed.withColumn("spills", (F.col("n_rows") >= max_rows) | (F.col("n_bytes") >= max_bytes))
