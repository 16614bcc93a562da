"""A change log derived from the ``events`` table, for queries and tests.

Eight lanes of users write transactions that interleave within blocks of 200 events. An event is
a change, an ``error`` a rollback to a savepoint 20 events back, and a record of its own ends a
transaction, except for the few that stay open near the end of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records, ``scn`` rising; an event's is twice its id, its transaction's end one more than its last."""
    e = F.col("event_id")
    lane, block = F.col("user_id") % 8, F.floor(e / 200).cast("long")
    op = (
        F.when(F.col("event_type").isin("signup", "purchase"), "INSERT").when(F.col("event_type") == "view", "UPDATE")
        .when(F.col("event_type") == "click", "DELETE").otherwise("SAVEPOINT_RB")
    )
    changes = table(spark, sf_dir, "events").select(
        F.lit(1).alias("thread"), F.floor(e / 100).cast("long").alias("sequence"), (2 * e % 200).alias("block_offset"),
        F.floor(e / 100).cast("long").alias("lwn"), (2 * e).alias("scn"), F.concat_ws(".", lane.cast("string"), block.cast("string")).alias("xid"),
        op.alias("op"), F.concat(F.lit("PDB"), (lane % 3 + 1).cast("string")).alias("container"), F.when(lane < 4, "APP").otherwise("CRM").alias("owner"),
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("table_name"), F.col("user_id").alias("object_id"),
        (2 * e - 40).alias("savepoint_scn"), F.lit(None).cast("string").alias("before"), F.col("props").alias("after"), (block * 8 + lane).alias("txn_no"),
    )
    ends = changes.groupBy("container", "xid").agg(F.max("scn").alias("last"), F.max("txn_no").alias("txn_no"))
    newest = ends.agg(F.max("txn_no")).scalar()
    end = F.when(F.col("txn_no") % 5 == 0, "ROLLBACK").when((F.col("txn_no") % 7 == 0) & (F.col("txn_no") >= newest - 16), "OPEN").otherwise("COMMIT")
    ends = ends.withColumn("op", end).where("op <> 'OPEN'")
    at = F.floor(F.col("last") / 200).cast("long")
    ended = ends.select(F.lit(1).alias("thread"), at.alias("sequence"), ((F.col("last") + 1) % 200).alias("block_offset"), at.alias("lwn"), (F.col("last") + 1).alias("scn"), "xid", "op", "container")
    return changes.drop("txn_no").unionByName(ended, allowMissingColumns=True)


#: The same log for DuckDB, as common table expressions ``rec`` (records), ``txn`` (outcomes),
#: ``live`` (changes no savepoint rollback undoes) and ``done`` (those of committed transactions).
LOG_SQL = """
with ev as (select event_id, user_id, event_type, props, user_id % 8 as lane, event_id // 200 as block from events),
chg as (select 1::int as thread, event_id // 100 as sequence, 2 * event_id % 200 as block_offset, event_id // 100 as lwn, 2 * event_id as scn,
    lane || '.' || block as xid,
    case when event_type in ('signup', 'purchase') then 'INSERT' when event_type = 'view' then 'UPDATE' when event_type = 'click' then 'DELETE' else 'SAVEPOINT_RB' end as op,
    'PDB' || (lane % 3 + 1) as container, case when lane < 4 then 'APP' else 'CRM' end as owner, 'T' || (user_id % 10) as table_name, user_id as object_id,
    2 * event_id - 40 as savepoint_scn, props as after, block * 8 + lane as txn_no from ev),
fin as (select container, xid, max(scn) as last, max(txn_no) as txn_no from chg group by 1, 2),
kind as (select *, case when txn_no % 5 = 0 then 'ROLLBACK' when txn_no % 7 = 0 and txn_no >= (select max(txn_no) from fin) - 16 then 'OPEN' else 'COMMIT' end as outcome from fin),
rec as (select thread, sequence, block_offset, lwn, scn, xid, op, container, owner, table_name, object_id, savepoint_scn, after from chg
    union all by name select 1::int as thread, last // 200 as sequence, (last + 1) % 200 as block_offset, last // 200 as lwn, last + 1 as scn, xid, outcome as op, container from kind where outcome <> 'OPEN'),
txn as (select container, xid, min(scn) as first_scn, max(scn) as end_scn, count(*) as n_records,
    case when max_by(op, scn) in ('COMMIT', 'ROLLBACK') then max_by(op, scn) else 'OPEN' end as outcome from rec group by 1, 2),
live as (select * from rec c where op in ('INSERT', 'UPDATE', 'DELETE') and not exists (
    select 1 from rec s where s.container = c.container and s.xid = c.xid and s.op = 'SAVEPOINT_RB' and c.scn > s.savepoint_scn and c.scn < s.scn)),
done as (select l.*, t.end_scn as commit_scn, row_number() over (partition by l.container, l.xid order by l.scn)::bigint as pos
    from live l join txn t using (container, xid) where t.outcome = 'COMMIT')
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of table structures: each of a user's INSERT events defines the user's object anew, every eleventh drops it."""
    rows = records(spark, sf_dir).where("op = 'INSERT'")
    return rows.select(
        "object_id", F.col("scn").alias("effective_scn"), F.concat(F.lit("v"), F.col("scn").cast("string")).alias("structure"), (F.col("scn") % 11 == 0).alias("tombstone")
    )


HISTORY_SQL = "hist as (select object_id, scn as effective_scn, 'v' || scn as structure, scn % 11 = 0 as tombstone from rec where op = 'INSERT')"
