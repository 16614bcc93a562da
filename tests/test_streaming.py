"""Sources, streams, state and the command line."""

import json
import os
import time

import pytest
from conftest import SMALL

from tidemark import __main__ as cli
from tidemark.plans.changelog import records
from tidemark.sources.config import ConfigError, load
from tidemark.sources.records import SCHEMA, ChangeRecords, LogTail, MissingLog, read_messages, record_files
from tidemark.streaming.queries import _log_files, stream_reassembly, stream_recovery, stream_rewind, stream_start_position
from tidemark.streaming.reassembly import ROCKSDB, reassembled
from tidemark.streaming.sink import State, StateError, StateFile, backup, delivered, restore, rewind


def write_log(folder, sequence, rows, thread=1):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"thread": thread, "sequence": sequence, "lwn": sequence, "block_offset": 0, "container": "C", "owner": "O", "table_name": "T", "object_id": 1} | r) for r in rows]
    new = folder / f"{thread}_{sequence}.tmp"
    new.write_text("".join(x + "\n" for x in lines))
    new.rename(folder / f"{thread}_{sequence}.jsonl")


def config_text(tmp_path, **more):
    base = {"source": {"records": str(tmp_path / "log"), "poll_interval_seconds": 0.2, "missing_file_timeout_seconds": 1}, "output": {"folder": str(tmp_path / "out")}, "include": [".*"], "state": str(tmp_path / "state")}
    return json.dumps(base | more)


def test_config(tmp_path):
    config = load(config_text(tmp_path, password="hush"))
    assert config.output.max_file_bytes == 256 << 20 and "hush" not in repr(config)
    assert config.fingerprint() == load(config_text(tmp_path, password="other")).fingerprint()
    for wrong in (
        config_text(tmp_path, unknown=1), config_text(tmp_path, include=[]), config_text(tmp_path, include=["("]), config_text(tmp_path, mappings={"/a/../b": "/c"}),
        '{"include": ["a"]}', "[", '{"include": ["a"], "include": ["b"]}', config_text(tmp_path, source={"records": "x", "block_size": 1000}),
    ):
        with pytest.raises(ConfigError):
            load(wrong)


def test_batch_source(spark, tmp_path):
    spark.dataSource.register(ChangeRecords)
    folder = tmp_path / "log"
    for s in (3, 4, 5):
        write_log(folder, s, [{"scn": 10 * s, "xid": "a", "op": "INSERT"}])
    read = spark.read.format("change_records").option("path", str(folder)).option("startSequence", 4)
    assert sorted(r.scn for r in read.load().collect()) == [40, 50]
    assert record_files(spark, str(folder)).count() == 3
    write_log(folder, 8, [])
    with pytest.raises(Exception, match="log 6 of thread 1 is missing"):
        read.load().collect()


def test_tail_waits_for_a_gap(tmp_path):
    folder = tmp_path / "log"
    write_log(folder, 0, [])
    write_log(folder, 2, [])
    tail = LogTail(str(folder), 1, 0, 0.3, 16, ["scn"])
    assert tail.latestOffset() == {"sequence": 1} and tail.latestOffset() == {"sequence": 1}
    write_log(folder, 1, [])  # a gap that closes
    assert tail.latestOffset() == {"sequence": 3}
    write_log(folder, 4, [])
    assert tail.latestOffset() == {"sequence": 3}
    time.sleep(0.4)
    with pytest.raises(MissingLog, match="log 3"):
        tail.latestOffset()
    assert [p.path.rsplit("/", 1)[1] for p in tail.partitions({"sequence": 0}, {"sequence": 2})] == ["1_0.jsonl", "1_1.jsonl"]


def test_cut_line_is_refused_by_the_source_and_skipped_by_consumers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.jsonl").write_text('{"scn": 1}\n{"scn": 2}\n{"scn": 3, "x')
    assert sorted(r.scn for r in read_messages(spark, str(tmp_path / "m"), "scn long").collect()) == [1, 2]
    (tmp_path / "m/1_0.jsonl").write_text('{"scn": 3, "x')
    with pytest.raises(ValueError, match="not a whole record"):
        tail = LogTail(str(tmp_path / "m"), 1, 0, 1, 1, ["scn"])
        list(tail.read(tail.partitions({"sequence": 0}, {"sequence": 1})[0]))


@pytest.mark.parametrize("query", [stream_reassembly, stream_recovery])
def test_streams_give_the_batch_result(spark, query):
    from tidemark.operators.transactions import committed

    got = sorted(map(tuple, query(spark, SMALL).select("commit_scn", "xid", "pos", "scn").collect()))
    assert got == sorted(map(tuple, committed(records(spark, SMALL)).select("commit_scn", "xid", "pos", "scn").collect()))


def test_log_files_rise_with_the_position(spark, tmp_path):
    """Else a batch has commits of changes that come later. The events lie in any order in many files."""
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(8, "user_id").write.parquet(str(tmp_path / "events.parquet"))
    _log_files(spark, str(tmp_path), str(tmp_path / "log"))
    files = sorted((tmp_path / "log").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    scns = [[json.loads(x)["scn"] for x in p.read_text().splitlines()] for p in files]
    assert len(files) > 4 and sum(map(len, scns)) == records(spark, SMALL).count()
    assert all(max(a) < min(b) for a, b in zip(scns, scns[1:], strict=False))


def reassembly_of(spark, tmp_path, *batches):
    """What the operator gives for files of records, a batch each, and the rows of state that each batch wrote."""
    for i, records in enumerate(batches):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / f"log/{i}.json").write_text("".join(json.dumps(r) + "\n" for r in records))
        os.utime(tmp_path / f"log/{i}.json", (i, i))
    got, key = [], "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = reassembled(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log")))
        write = stream.writeStream.foreachBatch(lambda df, _: got.extend(r.asDict() for r in df.collect()))
        job = write.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        job.awaitTermination()
        return got, [p["stateOperators"][0]["numRowsUpdated"] for p in job.recentProgress]
    finally:
        spark.conf.set(key, before)


def test_what_ends_in_its_batch_touches_no_state(spark, tmp_path):
    values = ["", "\\", "\\e", "\\u", "\\0", "\x1f", "a\x1f\\u\x1f", "\\\\0", '{"k": "\n\u00e9\U0001f600"}', None]
    records = [{"scn": i, "xid": x, "op": "UPDATE", "container": c, "object_id": i, "row_id": v, "before": v, "after": v, "ddl_text": v} for x in ("a", "b") for c in ("C", "D", None) for i, v in enumerate(values)]
    ends = [{"scn": 50, "xid": x, "op": "COMMIT" if x == "a" else "ROLLBACK", "container": c} for x in ("a", "b") for c in ("C", "D", None)]
    got, updated = reassembly_of(spark, tmp_path, records + ends)
    assert updated == [0]
    assert sorted((r["container"] or "", r["pos"], r["scn"], r["commit_scn"]) for r in got) == [(c, i + 1, i, 50) for c in ("", "C", "D") for i in range(len(values))]
    assert all(r["op"] == "UPDATE" and r["object_id"] == r["scn"] and r["owner"] is None and {r[k] for k in ("row_id", "before", "after", "ddl_text")} == {values[r["scn"]]} for r in got)


def test_large_transactions_over_batches(spark, tmp_path):
    """Without a container, in several portions, with one of which a part is undone in a later batch."""
    def change(i, xid="a"):
        return {"scn": i, "block_offset": i % 7, "xid": xid, "op": "INSERT", "after": str(i)}

    first, second = [change(i) for i in range(2500)], [change(i) for i in range(2500, 4000)]
    second += [{"scn": 4000, "xid": "a", "op": "SAVEPOINT_RB", "savepoint_scn": 1999}, change(4001), change(4002, "b")]
    third = [{"scn": 4003, "xid": "a", "op": "COMMIT"}, change(4004), {"scn": 4005, "xid": "a", "op": "ROLLBACK"}, change(4006), {"scn": 4007, "xid": "a", "op": "COMMIT"}, {"scn": 4008, "xid": "b", "op": "COMMIT"}]
    got, updated = reassembly_of(spark, tmp_path, first, second, third)
    want = [("a", 4003, n + 1, i) for n, i in enumerate([*range(2000), 4001])] + [("a", 4007, 1, 4006), ("b", 4008, 1, 4002)]
    assert sorted((r["xid"], r["commit_scn"], r["pos"], r["scn"]) for r in got) == want
    assert all(r["container"] is None and r["after"] == str(r["scn"]) for r in got)
    assert max(updated) < 10


@pytest.mark.parametrize(("query", "whole"), [(stream_start_position, 0), (stream_rewind, 1)])
def test_streams_from_a_position(spark, query, whole):
    from tidemark.operators.transactions import committed

    log = records(spark, SMALL)
    middle = max(r.scn for r in log.select("scn").collect()) // 2
    rows = [tuple(r) for r in committed(log).select("commit_scn", "xid", "pos", "scn").collect()]
    want = rows * whole + [r for r in rows if r[0] > middle]
    assert sorted(map(tuple, query(spark, SMALL).select("commit_scn", "xid", "pos", "scn").collect())) == sorted(want)


def test_capture_run_restart_and_rewind(spark, tmp_path):
    config = load(config_text(tmp_path, exclude=["C\\.O\\.HIDDEN"], output={"folder": str(tmp_path / "out"), "heartbeat": True}))
    log = tmp_path / "log"
    write_log(log, 0, [{"scn": 1, "xid": "a", "op": "INSERT", "after": "1"}, {"scn": 2, "xid": "b", "op": "INSERT"}, {"scn": 3, "xid": "b", "op": "ROLLBACK"}, {"scn": 4, "xid": "a", "op": "UPDATE", "table_name": "HIDDEN"}])
    assert cli.run(config, spark, until_idle=True) == 0
    write_log(log, 1, [{"scn": 5, "xid": "a", "op": "DELETE"}, {"scn": 6, "xid": "a", "op": "SAVEPOINT_RB", "savepoint_scn": 4}, {"scn": 7, "xid": "a", "op": "COMMIT"}])
    assert cli.run(config, spark, until_idle=True) == 0  # the open transaction comes out whole
    state = StateFile(config.state)
    lines = [json.loads(r.value) for r in delivered(spark, config.output.folder, state).orderBy("batch", "part").collect()]
    assert [(m["kind"], m["scn"]) for m in lines if m["kind"] != "chkpt"] == [("begin", None), ("dml", 1), ("commit", None)]
    assert any(m["kind"] == "chkpt" for m in lines) and "op" in lines[0]
    assert cli.status(config)["safe_scn"] == 7
    path = tmp_path / "config.json"
    path.write_text(config_text(tmp_path))
    assert cli.main(["validate", str(path)]) == 0 and cli.main(["status", str(path)]) == 0 and cli.main(["stop", str(path)]) == 0
    assert cli.main(["backup", str(path), "--folder", str(tmp_path / "copy")]) == 0
    assert cli.main(["rewind", str(path), "--scn", "5"]) == 0
    assert state.load().generation == 2
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert cli.run(config, spark, until_idle=True) == 0  # what committed after the target again, beside the old output
    assert set(before) < {p.name for p in (tmp_path / "out").iterdir()}
    again = [json.loads(r.value) for r in delivered(spark, config.output.folder, state).where("batch like 'g0002%'").orderBy("batch", "part").collect()]
    assert [(m["kind"], m["scn"]) for m in again if m["kind"] != "chkpt"] == [("begin", None), ("dml", 1), ("commit", None)]
    names = sorted(p.name for p in (tmp_path / "out").rglob("*.jsonl"))
    assert names == [f"changes-{i:06d}.jsonl" for i in range(1, len(names) + 1)]
    with pytest.raises(StateError, match="cannot rewind"):
        rewind(state, 99)
    assert cli.main(["restore", str(path), "--folder", str(tmp_path / "copy")]) == 0
    assert state.load().generation == 1


def test_start_within_a_transaction_ddl_and_preflight(spark, tmp_path):
    log = tmp_path / "log"
    write_log(
        log, 0,
        [{"scn": 0, "xid": "o", "op": "INSERT"}, {"scn": 1, "xid": "a", "op": "BEGIN"}, {"scn": 1, "xid": "a", "op": "INSERT", "row_id": "AAA", "container": None}, {"scn": 2, "xid": "o", "op": "COMMIT"},
         {"scn": 5, "xid": "a", "op": "DDL", "ddl_kind": "TRUNCATE", "ddl_text": "truncate table t", "container": None}, {"scn": 7, "xid": "a", "op": "COMMIT", "container": None}],
    )
    (tmp_path / "meta.json").write_text(json.dumps({"version": "19.3", "log_mode": "ARCHIVELOG", "supplemental_log": "YES", "force_logging": "YES", "paths_mapped": "YES", "files_readable": "YES", "privileges": "YES"}))
    source = {"records": "/remote/log", "poll_interval_seconds": 0.2, "start_scn": 4, "identity": {"dbid": 1}, "database": "MAIN", "metadata": str(tmp_path / "meta.json")}
    config = load(config_text(tmp_path, source=source, mappings={"/remote": str(tmp_path)}))
    assert cli.run(config, spark, until_idle=True) == 0
    state = StateFile(config.state)
    lines = [json.loads(r.value) for r in delivered(spark, config.output.folder, state).orderBy("batch", "part").collect()]
    assert [(m["kind"], m["scn"], m["db"]) for m in lines] == [("begin", None, "MAIN"), ("dml", 1, "MAIN"), ("ddl", 5, "MAIN"), ("commit", None, "MAIN")]
    assert lines[1]["row_id"] == "AAA" and lines[2]["ddl_text"] == "truncate table t"
    with pytest.raises(ValueError, match="lose changes"):
        cli.run(load(config_text(tmp_path, source=source | {"start_scn": 99}, mappings={"/remote": str(tmp_path)})), spark, until_idle=True)
    with pytest.raises(StateError, match="belongs to"):
        cli.run(load(config_text(tmp_path, source=source | {"identity": {"dbid": 2}}, mappings={"/remote": str(tmp_path)})), spark, until_idle=True)
    (tmp_path / "meta.json").write_text(json.dumps({"version": "19.3", "log_mode": "NOARCHIVELOG"}))
    with pytest.raises(Exception, match="NOARCHIVELOG"):
        cli.run(config, spark, until_idle=True)


def test_patterns_are_those_of_the_jvm(spark, tmp_path):
    assert load(config_text(tmp_path, include=[r"\p{Lu}+\.T"])).include
    with pytest.raises(ConfigError):
        load(config_text(tmp_path, include=["(?P<a>X)"]))


def test_missing_log_stops_the_run_with_its_position(spark, tmp_path):
    config = load(config_text(tmp_path))
    log = tmp_path / "log"
    write_log(log, 0, [{"scn": 1, "xid": "a", "op": "INSERT"}, {"scn": 2, "xid": "a", "op": "COMMIT"}])
    write_log(log, 2, [{"scn": 9, "xid": "z", "op": "INSERT"}])
    assert cli.run(config, spark) == 2
    assert StateFile(config.state).load().safe_scn == 2
    assert "log 1 of thread 1 has not come" in (tmp_path / "state/tidemark.log").read_text()


def test_state(tmp_path):
    state = StateFile(str(tmp_path / "s"))
    assert state.load() == State()
    state.save(State(identity={"dbid": 1}, safe_scn=4))
    assert state.check({"dbid": 1}).safe_scn == 4
    with pytest.raises(StateError, match="belongs to"):
        state.check({"dbid": 2})
    backup(str(tmp_path / "s"), str(tmp_path / "copy"))
    with pytest.raises(StateError, match="belongs to"):
        restore(str(tmp_path / "copy"), str(tmp_path / "s"), {"dbid": 2})
    state.path.write_text(json.dumps({"version": 1, "identity": {"dbid": 1}, "safe_scn": 7, "generation": 2, "batches": {"1-0": 3, "1-1": 5, "2-0": 7}}))
    new = state.load()
    assert new.counted == {"1": 1, "2": 0} and new.version == 2 and new.migrations[0]["version"] == 2 and (tmp_path / "s/state.v1").exists()
    assert state.load() == new
    new.migrations[0]["checksum"] = "other"
    state.save(new)
    with pytest.raises(StateError, match="not the one that was applied"):
        state.load()
    with pytest.raises(StateError, match="mount"):
        StateFile("hdfs://host/state")
    restore(str(tmp_path / "copy"), str(tmp_path / "s"), {"dbid": 1})
    state.save(State(version=99))
    with pytest.raises(StateError, match="newer"):
        state.load()
    state.path.write_text("{")
    with pytest.raises(StateError, match="damaged"):
        state.load()


def test_entry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"committed_in_order", "stream_recovery"} <= names
