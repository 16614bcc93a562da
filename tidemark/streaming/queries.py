"""Streaming queries over the derived log, run to the end of their input."""

from __future__ import annotations

import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.changelog import LOG_SQL, records
from ..session import shared_folder
from ..sources.records import SCHEMA
from .reassembly import ROCKSDB, reassembled
from .sink import OrderedSink, StateFile, delivered, local, rewind

#: Record files that make a batch.
FILES = 4
COLUMNS = "commit_scn, container, xid, pos, scn, op, owner, table_name, after"


def _log_files(spark: SparkSession, sf_dir: str, folder: str, rows: int = 1 << 18) -> None:
    """The log as record files whose names and times rise with the position, of about ``rows`` records.

    The stream takes files by their times, so a file must hold no position beyond those of the next: a
    commit would else come before its changes. Tasks end in any order, so times are set afterwards.
    """
    log = records(spark, sf_dir)
    files = max(2 * FILES, -(-log.count() // rows))
    log.repartitionByRange(files, "scn").sortWithinPartitions("scn").write.json(folder)
    written, now = sorted(Path(local(folder)).glob("part-*")), time.time()
    for i, file in enumerate(written):
        os.utime(file, (now, now + i - len(written)))


def _run(spark: SparkSession, sf_dir: str, fail_at: int | None = None, after: int | None = None, at: str | None = None) -> tuple[str, StateFile]:
    """Runs the stream until its input is used up; with ``fail_at`` that batch fails after its write and is run again.

    Transactions that committed up to ``after`` are not delivered. ``at``: the folder of an earlier run to rewind to there.
    """
    again, at = at is not None, at or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if local(at) is None:
        raise ValueError("the streams keep their state record in spark.checkpoint.dir, which must be a mounted folder")
    state = StateFile(f"{local(at)}/state")
    if again:
        rewind(state, after)
    else:
        _log_files(spark, sf_dir, f"{at}/log")
    sink = OrderedSink(f"{at}/out", state)
    failed: list[int] = []

    def deliver(changes: DataFrame, batch_id: int) -> None:
        sink(changes, batch_id)
        if batch_id == fail_at and not failed:
            failed.append(batch_id)
            raise RuntimeError("stopped after the write, before the batch was committed")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        while True:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES).json(f"{at}/log")
            changes = reassembled(stream)
            changes = changes if after is None else changes.where(F.col("commit_scn") > after)
            job = changes.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{at}/checkpoint-{state.load().generation}").trigger(availableNow=True).start()
            try:
                job.awaitTermination()
                return f"{at}/out", state
            except Exception:
                if not failed or len(failed) > 1:
                    raise
                failed.append(-1)
    finally:
        spark.conf.set(key, before)


def _lines(spark: SparkSession, out: tuple[str, StateFile]) -> DataFrame:
    schema = "kind string, commit_scn long, container string, xid string, pos long, op string, owner string, table_name string, scn long, after string"
    lines = delivered(spark, *out).select(F.from_json("value", schema).alias("m")).select("m.*")
    return lines.where("kind in ('dml', 'ddl')").select(*COLUMNS.split(", "))


def stream_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, _run(spark, sf_dir))


def stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, _run(spark, sf_dir, fail_at=1))


def _middle(spark: SparkSession, sf_dir: str) -> int:
    return records(spark, sf_dir).agg(F.max("scn")).first()[0] // 2


def stream_start_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the middle of the log on: transactions that began before and committed after come whole."""
    return _lines(spark, _run(spark, sf_dir, after=_middle(spark, sf_dir)))


def stream_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log, then a rewind to its middle: what committed after it comes again, beside the old output."""
    out, _ = _run(spark, sf_dir)
    return _lines(spark, _run(spark, sf_dir, after=_middle(spark, sf_dir), at=out.removesuffix("/out")))


QUERIES = {f.__name__: f for f in (stream_reassembly, stream_recovery, stream_start_position, stream_rewind)}
ORACLE_SQL = {"stream_reassembly": LOG_SQL + f"select {COLUMNS} from done", "stream_recovery": LOG_SQL + f"select {COLUMNS} from done"}
_AFTER = f"select {COLUMNS} from done where commit_scn > (select max(scn) // 2 from rec)"
ORACLE_SQL["stream_start_position"] = LOG_SQL + _AFTER
ORACLE_SQL["stream_rewind"] = LOG_SQL + f"select {COLUMNS} from done union all {_AFTER}"
