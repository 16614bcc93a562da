"""Sources of decoded change records.

Record files hold one JSON object a line and are named ``<thread>_<sequence>.jsonl``. Decoding a
database's binary log into them is outside this library: whatever decodes writes such files.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "thread int, sequence long, block_offset long, lwn long, scn long, xid string, op string, container string, owner string, "
    "table_name string, object_id long, data_object_id long, row_id string, savepoint_scn long, before string, after string, ddl_kind string, ddl_text string"
)
NAME = re.compile(r"^(\d+)_(\d+)\.jsonl$")


class MissingLog(RuntimeError):
    """A log file in sequence has not come in time; positions stay where they are."""


class LogFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _rows(path: str, names: Sequence[str]) -> Iterator[tuple]:
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            try:
                r = json.loads(line)
            except ValueError as e:
                raise ValueError(f"{path}, line {n}: not a whole record") from e
            yield tuple(r.get(k) for k in names)


def _logs(folder: str, thread: int) -> dict[int, str]:
    found = (NAME.match(n) for n in os.listdir(folder))
    return {int(m[2]): os.path.join(folder, m[0]) for m in found if m and int(m[1]) == thread}


class ArchivedLogs(DataSourceReader):
    """One partition for each log file from ``start`` on; a gap in the sequence is an error."""

    def __init__(self, folder: str, thread: int, start: int, names: Sequence[str]):
        self.folder, self.thread, self.start, self.names = folder, thread, start, names

    def partitions(self) -> list[LogFile]:
        logs = {s: p for s, p in _logs(self.folder, self.thread).items() if s >= self.start}
        if logs and (gap := sorted(set(range(min(logs), max(logs))) - set(logs))):
            raise MissingLog(f"log {gap[0]} of thread {self.thread} is missing")
        return [LogFile(logs[s]) for s in sorted(logs)]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return _rows(partition.path, self.names)


class LogTail(DataSourceStreamReader):
    """Follows a thread's logs. The offset is the next sequence; a batch has whole logs, in order.

    If a later log is there while the next is not, it is waited for until ``timeout`` seconds have
    passed since that was first seen; then the query fails with its offset unchanged.
    """

    def __init__(self, folder: str, thread: int, start: int, timeout: float, most: int, names: Sequence[str]):
        self.folder, self.thread, self.start, self.timeout, self.most, self.names = folder, thread, start, timeout, most, names
        self.at, self.missing_since = start, None

    def initialOffset(self) -> dict:
        return {"sequence": self.start}

    def latestOffset(self) -> dict:
        logs = _logs(self.folder, self.thread)
        to = self.at
        while to in logs and to - self.at < self.most:
            to += 1
        if to == self.at and any(s > to for s in logs):
            now = time.monotonic()
            self.missing_since = self.missing_since or now
            if now - self.missing_since >= self.timeout:
                raise MissingLog(f"log {to} of thread {self.thread} has not come within {self.timeout} s")
        else:
            self.missing_since = None
        self.at = to
        return {"sequence": to}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        self.at = max(self.at, end["sequence"])
        logs = _logs(self.folder, self.thread)
        return [LogFile(logs[s]) for s in range(start["sequence"], end["sequence"])]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        return _rows(partition.path, self.names)

    def commit(self, end: dict) -> None:
        pass


class ChangeRecords(DataSource):
    """``spark.read`` or ``readStream`` ``.format("change_records")`` with options ``path``, ``thread`` (1),
    ``startSequence`` (0), ``timeoutSeconds`` (300) and ``maxLogs`` (16). The folder must be visible to all executors."""

    @classmethod
    def name(cls) -> str:
        return "change_records"

    def schema(self) -> str:
        return SCHEMA

    def _at(self) -> tuple[str, int, int]:
        return self.options["path"], int(self.options.get("thread", 1)), int(self.options.get("startSequence", 0))

    def reader(self, schema: StructType) -> ArchivedLogs:
        return ArchivedLogs(*self._at(), schema.names)

    def streamReader(self, schema: StructType) -> LogTail:
        return LogTail(*self._at(), float(self.options.get("timeoutSeconds", 300)), int(self.options.get("maxLogs", 16)), schema.names)


def record_files(spark: SparkSession, path: str) -> DataFrame:
    """Record files by Spark's own reader, for batch jobs over any store that Spark reads."""
    return spark.read.schema(SCHEMA).json(path)


def metadata(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A metadata query over JDBC (identity, archives, dictionary); never log content. Needs the database's driver jar."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_messages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Output lines as a consumer reads them: whole lines only."""
    lines = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return lines.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
