"""Queries that apply the operators to the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import types
from ..operators import checks, positions, rolling, schemas, scope, transactions
from .changelog import HISTORY_SQL, LOG_SQL, history, records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, log: bool = True):
    """Registers a query; ``sql`` goes on after the log's common table expressions if ``log``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (LOG_SQL + sql) if log else sql
        return f

    return register


@query("select outcome, count(*) as n_txns, sum(n_records)::bigint as n_records from txn group by 1")
def txn_outcome(spark, sf_dir):
    return transactions.outcomes(records(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n_txns"), F.sum("n_records").alias("n_records"))


@query("select dense_rank() over (order by commit_scn)::bigint as commit_rank, commit_scn, container, xid, pos, scn, op, owner, table_name, after from done")
def committed_in_order(spark, sf_dir):
    rows = transactions.in_commit_order(records(spark, sf_dir))
    rows = rows.select("commit_rank", "commit_scn", "container", "xid", "pos", "scn", "op", "owner", "table_name", "after")
    return rows.orderBy("commit_rank", "container", "xid", "pos")


@query("select container, xid, scn, op from live")
def savepoint_rollback(spark, sf_dir):
    return transactions.without_undone(records(spark, sf_dir)).select("container", "xid", "scn", "op")


@query(", seen as (select distinct thread, sequence from rec where sequence % 17 <> 3), l as (select *, lag(sequence) over (partition by thread order by sequence) as b from seen) select thread, b as after_sequence, sequence as next_sequence from l where sequence <> b + 1")
def sequence_gaps(spark, sf_dir):
    return positions.sequence_gaps(records(spark, sf_dir).where("sequence % 17 <> 3"))


@query("select thread, sequence, lwn, max(scn) as durable_scn from rec group by 1, 2, 3")
def durable_position(spark, sf_dir):
    return positions.durable_positions(records(spark, sf_dir))


@query(
    ", d as (select thread, sequence, lwn, max(scn) as durable_scn from rec group by 1, 2, 3) select thread, sequence, lwn, durable_scn, "
    "(select min(first_scn) from txn t where t.first_scn <= d.durable_scn and (t.outcome = 'OPEN' or d.durable_scn < t.end_scn)) as low_watermark from d"
)
def low_watermark_by_lwn(spark, sf_dir):
    log = records(spark, sf_dir)
    return positions.low_watermarks(positions.durable_positions(log), transactions.outcomes(log))


@query(f", {HISTORY_SQL}, m as (select r.scn, r.object_id, max(h.effective_scn) as v from rec r left join hist h on h.object_id = r.object_id and h.effective_scn <= r.scn where r.op in ('UPDATE', 'DELETE') group by 1, 2) select m.scn, m.object_id, case when not h.tombstone then h.effective_scn end as version_scn, case when not h.tombstone then h.structure end as structure from m left join hist h on h.object_id = m.object_id and h.effective_scn = m.v")
def schema_as_of(spark, sf_dir):
    changes = records(spark, sf_dir).where("op in ('UPDATE', 'DELETE')").select("scn", "object_id")
    return schemas.as_of(changes, history(spark, sf_dir))


@query(f", {HISTORY_SQL} select *, lead(effective_scn) over (partition by object_id order by effective_scn) as valid_to from hist")
def schema_validity(spark, sf_dir):
    return schemas.validity(history(spark, sf_dir))


@query(
    f", {HISTORY_SQL}, c as (select scn, object_id from rec where op in ('UPDATE', 'DELETE')), "
    "f as (select c.*, (select arg_max(structure, effective_scn) from hist h where h.object_id = c.object_id and h.effective_scn <= c.scn and h.effective_scn % 4 = 0) as s0, "
    "(select arg_max(tombstone, effective_scn) from hist h where h.object_id = c.object_id and h.effective_scn <= c.scn and h.effective_scn % 4 = 0) as t0, "
    "(select arg_max(structure, effective_scn) from hist h where h.object_id = c.object_id and h.effective_scn <= c.scn) as s1, "
    "(select arg_max(tombstone, effective_scn) from hist h where h.object_id = c.object_id and h.effective_scn <= c.scn) as t1 from c) "
    "select scn, object_id, case when t0 is not null then case when not t0 then s0 end when not t1 then s1 end as structure, case when t0 is not null then 0 when t1 is not null then 1 end::int as source_no from f"
)
def schema_fallback(spark, sf_dir):
    changes = records(spark, sf_dir).where("op in ('UPDATE', 'DELETE')").select("scn", "object_id")
    whole = history(spark, sf_dir)
    return schemas.with_fallbacks(changes, whole.where("effective_scn % 4 = 0"), whole)


MAPPINGS = {"/Customer": "/a", "/Customer#0000": "/b", "/Customer#00000001": "/c/d"}


@query(
    "select c_custkey, case when starts_with('/' || replace(c_name, ' ', ''), '/Customer#00000001') then '/c/d' || substr('/' || c_name, 19) "
    "when starts_with('/' || c_name, '/Customer#0000') then '/b' || substr('/' || c_name, 15) when starts_with('/' || c_name, '/Customer') then '/a' || substr('/' || c_name, 10) end as local_path from customer",
    log=False,
)
def path_longest_prefix(spark, sf_dir):
    path = F.concat(F.lit("/"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", scope.mapped_path(path, MAPPINGS).alias("local_path"))


@query("select container || '.' || owner || '.' || table_name as name, scn from rec where op in ('INSERT', 'UPDATE', 'DELETE') and regexp_full_match(container || '.' || owner || '.' || table_name, 'PDB[12]\\.APP\\..*|PDB3\\..*\\.T[0-4]') and not regexp_full_match(container || '.' || owner || '.' || table_name, '.*\\.T[37]')")
def include_exclude(spark, sf_dir):
    rows = records(spark, sf_dir).where("op in ('INSERT', 'UPDATE', 'DELETE')").withColumn("name", scope.full_name())
    return rows.where(scope.in_scope(F.col("name"), [r"PDB[12]\.APP\..*", r"PDB3\..*\.T[0-4]"], [r".*\.T[37]"])).select("name", "scn")


@query("select distinct p_type from part where p_type like '%A%E%' or p_type like 'S%'", log=False)
def pattern_semi_join(spark, sf_dir):
    patterns = spark.createDataFrame([("(?s).*A.*E.*",), ("(?s)S.*",)], "pattern string")
    return scope.matching(table(spark, sf_dir, "part").select("p_type").distinct(), patterns, "p_type")


@query("select event_id, lower(lpad(to_hex(event_id % 65536), 4, '0')) || '.' || lower(lpad(to_hex(user_id % 4096), 3, '0')) || '.' || lower(lpad(to_hex(event_id * 7919), 8, '0')) as xid from events", log=False)
def xid_hex(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", types.xid_text(e % 65536, F.col("user_id") % 4096, e * 7919).alias("xid"))


MESSAGE_SQL = (
    ", ends as (select container, xid, max(commit_scn) as commit_scn, max(pos) as last from done group by 1, 2), msg as ("
    "select 'dml' as kind, commit_scn, container, xid, pos, op from done union all select 'begin', commit_scn, container, xid, 0, null from ends union all select 'commit', commit_scn, container, xid, last + 1, null from ends) "
)


@query(MESSAGE_SQL + "select kind, commit_scn, container, xid, pos, op from msg")
def message_split(spark, sf_dir):
    return transactions.messages(transactions.committed(records(spark, sf_dir)))


@query(MESSAGE_SQL + "select kind, commit_scn, container, xid, pos, op from msg where commit_scn % 5 <> 0")
def complete_txns(spark, sf_dir):
    rows = transactions.messages(transactions.committed(records(spark, sf_dir)))
    return transactions.complete(rows.where("kind <> 'commit' or commit_scn % 5 <> 0"))


@query(MESSAGE_SQL + "select kind, commit_scn, container, xid, pos, op from msg")
def dedupe_replay(spark, sf_dir):
    rows = transactions.messages(transactions.committed(records(spark, sf_dir)))
    times = F.when(F.col("commit_scn") % 3 == 0, 2).otherwise(1)
    return transactions.once(rows.withColumn("time", F.explode(F.sequence(F.lit(1), times))).drop("time"))


@query(MESSAGE_SQL + "select kind, commit_scn, container, xid, pos, op from msg union all select 'chkpt', d, null, null, null, null from (select max(scn) as d from rec group by lwn)")
def heartbeat(spark, sf_dir):
    log = records(spark, sf_dir)
    marks = positions.durable_positions(log).select(F.col("durable_scn").alias("scn"))
    return transactions.with_heartbeat(transactions.messages(transactions.committed(log)), marks, True)


@query("select event_id, (props::json->>'k')::bigint as k from events", log=False)
def payload_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("select event_type, quantile_cont(value, 0.95) as p95 from events group by 1", log=False)
def latency_p95(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.95).alias("p95"))


@query("select date_trunc('hour', ts) as hour, count(*) as n_rows, count(*) / 3600.0::double as rows_per_second from events group by 1", log=False)
def throughput(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(n.alias("n_rows"), (n / 3600.0).alias("rows_per_second"))


@query("select container, xid, count(*) as n_rows, sum(strlen(after))::bigint as n_bytes, count(*) >= 20 or sum(strlen(after)) >= 200 as spills from rec where op in ('INSERT', 'UPDATE', 'DELETE') group by 1, 2")
def txn_size_limits(spark, sf_dir):
    return transactions.sizes(records(spark, sf_dir), 20, 200)


@query(
    ", s as (select object_id, max(scn) as capture_from_scn from rec where op = 'INSERT' group by 1) select r.scn, r.object_id, r.op from rec r join s using (object_id) where r.op in ('INSERT', 'UPDATE', 'DELETE') and r.object_id % 5 <> 0 and r.scn >= s.capture_from_scn"
)
def late_table_capture(spark, sf_dir):
    log = records(spark, sf_dir).where("op in ('INSERT', 'UPDATE', 'DELETE')")
    starts = log.where("op = 'INSERT' and object_id % 5 <> 0").groupBy("object_id").agg(F.max("scn").alias("capture_from_scn"))
    return schemas.captured_from(log.select("scn", "object_id", "op"), starts)


@query("select scn, object_id from rec where op = 'INSERT' and object_id in (select object_id from rec where op = 'DELETE')")
def ddl_relevance(spark, sf_dir):
    log = records(spark, sf_dir)
    return schemas.relevant_ddl(log.where("op = 'INSERT'").select("scn", "object_id"), log.where("op = 'DELETE'"))


@query("select container, owner, count(*) as n_rows, min(scn) as first_scn, max(scn) as last_scn from done group by 1, 2")
def multi_container(spark, sf_dir):
    return transactions.committed(records(spark, sf_dir)).groupBy("container", "owner").agg(F.count("*").alias("n_rows"), F.min("scn").alias("first_scn"), F.max("scn").alias("last_scn"))


@query("select scn, coalesce(container, 'MAIN') as db from (select scn, case when scn % 3 = 0 then null else container end as container from rec)")
def db_name(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("container", F.when(F.col("scn") % 3 != 0, F.col("container"))).withColumn("database", F.lit("MAIN"))
    return rows.select("scn", scope.database_name().alias("db"))


@query("select p_partkey, p_size % 13 as code, case when p_size % 13 in (1, 2, 12) then p_name else '?' end as value from part", log=False)
def unsupported_placeholder(spark, sf_dir):
    code = F.col("p_size") % 13
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), types.shown(code, F.col("p_name")).alias("value"))


@query("select l_orderkey, n::bigint as n from (select l_orderkey, unnest(range(1, l_linenumber + 1)) as n from lineitem)", log=False)
def multi_row_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.sequence(F.lit(1), "l_linenumber")).alias("n"))
    return rows.select("l_orderkey", F.col("n").cast("long").alias("n"))


@query(
    "with recursive d as (select doc_id, octet_length(encode(text))::bigint as size, row_number() over (order by doc_id) as n from documents), "
    "f as (select n, doc_id, size as filled, 1::bigint as file_no from d where n = 1 union all "
    "select d.n, d.doc_id, case when f.filled >= 100000 then d.size else f.filled + d.size end, case when f.filled >= 100000 then f.file_no + 1 else f.file_no end from f join d on d.n = f.n + 1) "
    "select doc_id, file_no, 'changes-' || lpad(file_no::varchar, 6, '0') || '.jsonl' as file from f",
    log=False,
)
def roll_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return rolling.files(rows, "doc_id", "size", 100_000).select("doc_id", "file_no", rolling.file_name(F.col("file_no")).alias("file"))


@query("select case when o_orderkey % 50 <> 0 then o_orderkey end as scn, (select max(event_id // 100) from events where event_id % 100 = 0 and 2000 * (event_id // 200) <= case when o_orderkey % 50 <> 0 then o_orderkey end) as sequence from orders", log=False)
def archive_covering(spark, sf_dir):
    sequence = F.floor(F.col("event_id") / 100)  # two archives start at each position
    archives = table(spark, sf_dir, "events").where("event_id % 100 = 0").select(sequence.alias("sequence"), (2000 * F.floor(sequence / 2)).alias("first_scn"))
    return positions.archive_for(archives, table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("scn")))


@query("select thread, min(sequence) as sequence, min(scn) as first_scn from rec group by 1")
def earliest_archive(spark, sf_dir):
    return positions.earliest_archive(records(spark, sf_dir).select("thread", "sequence", F.col("scn").alias("first_scn")))


@query(
    ", o as (select user_id * 10 as data_object_id, user_id as object_id, min(2 * event_id) as effective_scn from events group by 1, 2 union all "
    "select (user_id - 1) * 10, user_id, max(2 * event_id) from events where user_id > 1 group by 1, 2) "
    "select scn, r.object_id * 10 as data_object_id, (select arg_max(o.object_id, o.effective_scn * 100000 + o.object_id) from o where o.data_object_id = r.object_id * 10 and o.effective_scn <= r.scn) as object_id from rec r where op = 'UPDATE'"
)
def data_objects(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select("user_id", (2 * F.col("event_id")).alias("scn"))
    own = seen.groupBy("user_id").agg(F.min("scn").alias("a"), F.max("scn").alias("b"))
    objects = own.select((F.col("user_id") * 10).alias("data_object_id"), F.col("user_id").alias("object_id"), F.col("a").alias("effective_scn")).union(
        own.where("user_id > 1").select((F.col("user_id") - 1) * 10, "user_id", "b")
    )
    changes = records(spark, sf_dir).where("op = 'UPDATE'").select("scn", (F.col("object_id") * 10).alias("data_object_id"))
    return schemas.by_data_object(changes, objects).select("scn", "data_object_id", "object_id")


@query("select c_nationkey % 5 as object_id, count(*) as n from customer group by 1", log=False)
def partition_to_logical(spark, sf_dir):
    parts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("object_id"), (F.col("n_nationkey") % 5).alias("parent_id"))
    rows = schemas.to_logical_table(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("object_id")), parts)
    return rows.groupBy("object_id").agg(F.count("*").alias("n"))


@query("select user_id, string_agg(event_type, '' order by event_id) as body, count(*) as n_pieces from events group by 1", log=False)
def lob_reassembly(spark, sf_dir):
    pieces = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("body"))
    return schemas.assemble_lob(pieces, ["user_id"], "event_id", "body")


@query("select user_id, string_agg(event_type || '=' || v, ',' order by event_type) as row from (select user_id, event_type, max_by(event_id, event_id) as v from events group by 1, 2) group by 1", log=False)
def row_pieces(spark, sf_dir):
    pieces = table(spark, sf_dir, "events").select("user_id", "event_id", F.create_map("event_type", F.col("event_id").cast("string")).alias("values"))
    whole = schemas.merge_pieces(pieces, ["user_id"], "event_id")
    shown = F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return whole.select("user_id", F.array_join(shown, ",").alias("row"))


@query("select 0::bigint as n_extra, count(*) as n_missing from events where event_id % 10 = 0", log=False)
def json_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.format_string('{"id": %d, "p": %s}', "event_id", "props").alias("j"))
    turned = table(spark, sf_dir, "events").where("event_id % 10 <> 0").select("event_id", F.format_string('{"p":%s,"id":%d}', "props", "event_id").alias("j"))
    found = checks.difference(turned, rows, ["j"])
    return found.agg(F.count_if(F.col("side") == "extra").alias("n_extra"), F.count_if(F.col("side") == "missing").alias("n_missing"))


@query("select 'version' as \"check\", '19.3' as found, true as ok union all select 'log_mode', 'NOARCHIVELOG', false union all select 'supplemental_log', 'YES', true union all select 'force_logging', 'NO', false union all select 'paths_mapped', 'YES', true union all select 'files_readable', null, false union all select 'privileges', 'YES', true", log=False)
def preflight(spark, sf_dir):
    found = spark.createDataFrame([("19.3", "NOARCHIVELOG", "YES", "NO", "YES", "YES")], "version string, log_mode string, supplemental_log string, force_logging string, paths_mapped string, privileges string")
    return checks.preflight(found).drop("hint")


@query("select p_partkey, sha256('{\"name\":\"' || p_name || '\",\"size\":' || p_size || '}') as fingerprint from part", log=False)
def config_fingerprint(spark, sf_dir):
    text = F.format_string('{"size": %d, "name": "%s"}', "p_size", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", types.fingerprint(text).alias("fingerprint"))


@query(
    "select s_suppkey, s_acctbal as n, upper(s_name) as raw_hex, s_acctbal::float as f, date_trunc('second', timestamp '2020-01-01' + to_seconds(s_suppkey)) as d, s_suppkey % 2 = 0 as b from supplier",
    log=False,
)
def type_decode(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    when = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("s_suppkey")), "yyyy-MM-dd HH:mm:ss")
    return s.select(
        "s_suppkey",
        types.typed(2, F.col("s_acctbal").cast("string"), 20, 4).cast("double").alias("n"),
        F.upper(types.typed(23, F.hex("s_name")).cast("string")).alias("raw_hex"),
        types.typed(100, F.col("s_acctbal").cast("string")).alias("f"),
        types.typed(12, when).alias("d"),
        types.typed(252, F.when(F.col("s_suppkey") % 2 == 0, "true").otherwise("false")).alias("b"),
    )


@query("select doc_id, text as decoded from documents", log=False)
def charset_decode(spark, sf_dir):
    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode("gb18030"))

    return table(spark, sf_dir, "documents").select("doc_id", types.decoded_by_python(encode("text"), "ZHS32GB18030").alias("decoded"))


@query(
    ", o as (select *, row_number() over (partition by object_id order by scn) as k, count(*) over (partition by object_id order by scn rows unbounded preceding) as n from rec where op = 'INSERT') "
    "select object_id, scn as effective_scn, case when k % 7 <> 0 then k % 7 - 1 end::bigint as n_added, k % 7 = 0 as tombstone from o"
)
def ddl_fold(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("object_id").orderBy("scn"))
    rows = records(spark, sf_dir).where("op = 'INSERT'").select("object_id", "scn", k.alias("k"))
    kind = F.when(F.col("k") % 7 == 1, "CREATE").when(F.col("k") % 7 == 0, "DROP").otherwise("ALTER")
    create = F.lit(json.dumps({"columns": [{"name": "ID"}]}))
    text = F.when(kind == "CREATE", create).when(kind == "ALTER", F.format_string('{"add": [{"name": "C%d"}]}', "k")).otherwise("{}")
    folded = schemas.fold_ddl(rows.select("object_id", "scn", kind.alias("ddl_kind"), text.alias("ddl_text")))
    added = F.size(F.from_json("structure", "array<struct<name:string>>")) - 1
    return folded.select("object_id", "effective_scn", F.when(~F.col("tombstone"), added).cast("long").alias("n_added"), "tombstone")
