"""Ordered delivery of committed changes, recoverable and at least once.

Each batch becomes a folder of JSON lines, written by Spark in commit order. Its files are then
numbered on from the last batch's, such as ``changes-000007.jsonl``, and brought to disk. Only then
does the state record, replaced as a whole, count the batch. A replayed batch overwrites its own
folder with the same numbers, and a folder beyond those counted is no output, so a cut batch is
never read. Output is on any file system that Spark writes; the state record is a local file.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import shutil
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import to_json
from ..operators.transactions import messages


class StateError(RuntimeError):
    """Stored state does not fit this job or its output."""


@dataclass
class State:
    """What is durable: one record of fixed size but for a line a rewind, overwritten after each batch.

    ``counted``: the last batch that counts, by generation. ``files``: how many files of output there
    are. ``floor``: transactions that committed up to it are not delivered in this generation.
    """

    identity: dict = field(default_factory=dict)
    fingerprint: str = ""
    version: int = 2
    safe_scn: int = -1
    counted: dict[str, int] = field(default_factory=dict)
    files: int = 0
    floor: int | None = None
    generation: int = 1
    migrations: list[dict] = field(default_factory=list)


def _compact_batches(state: dict) -> dict:
    """Batches are counted by the last one of each generation."""
    counted: dict[str, int] = {}
    for k in state.pop("batches", {}):
        generation, batch = k.split("-")
        counted[generation] = max(counted.get(generation, -1), int(batch))
    return state | {"counted": counted}


#: What brings a state record of a version to the next one.
MIGRATIONS: dict[int, Callable[[dict], dict]] = {1: _compact_batches}
VERSION = 2


def _checksum(step: Callable) -> str:
    return hashlib.sha256(inspect.getsource(step).encode()).hexdigest()


def _migrated(state: dict) -> dict:
    while state.get("version", 1) < VERSION:
        version = state.get("version", 1)
        step = MIGRATIONS[version]
        done = {"version": version + 1, "description": inspect.getdoc(step), "checksum": _checksum(step), "applied_at": time.time()}
        state = step(state) | {"version": version + 1, "migrations": [*state.get("migrations", []), done]}
    return state


def _atomic(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(".new")
    with new.open("w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    new.replace(path)
    _sync(path.parent)


def _sync(path: Path) -> None:
    at = os.open(path, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def local(path: str) -> str | None:
    """The path on this machine's file system, null for one on another."""
    at = urlparse(path)
    return at.path if at.scheme in ("", "file") else None


class StateFile:
    """The state record in a folder of the driver's machine."""

    def __init__(self, folder: str):
        at = local(folder)
        if at is None:
            raise StateError(f"{folder}: the state record needs a folder of this machine's file system, which may be a shared mount")
        self.path = Path(at) / "state.json"

    def load(self) -> State:
        if not self.path.exists():
            return State()
        try:
            found = json.loads(self.path.read_text())
            version = found.get("version", 1)
            if version > VERSION:
                raise StateError(f"state has version {version}, newer than {VERSION}")
            for m in found.get("migrations", ()):
                if m["version"] - 1 in MIGRATIONS and m["checksum"] != _checksum(MIGRATIONS[m["version"] - 1]):
                    raise StateError(f"the migration to version {m['version']} is not the one that was applied")
            if version < VERSION:
                shutil.copy(self.path, self.path.with_suffix(f".v{version}"))
                found = _migrated(found)
                _atomic(self.path, json.dumps(found))
            return State(**found)
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            raise StateError(f"{self.path} is damaged: {e}") from e

    def save(self, state: State) -> None:
        _atomic(self.path, json.dumps(asdict(state)))

    def check(self, identity: dict) -> State:
        """The state, if it belongs to the database with this identity."""
        state = self.load()
        if state.identity and state.identity != identity:
            raise StateError(f"state belongs to {state.identity}, not to {identity}")
        state.identity = identity
        return state


class OrderedSink:
    """For ``foreachBatch``: writes a batch's messages in commit order and then the state.

    ``database`` names the database in messages of changes without a container.
    """

    def __init__(
        self, folder: str, state: StateFile, identity: dict | None = None, max_file_bytes: int = 256 << 20, heartbeat: bool = False,
        status: str | None = None, prefix: str = "changes", database: str | None = None,
    ):
        self.folder, self.state, self.identity, self.prefix, self.database = folder, state, identity or {}, prefix, database
        self.max_file_bytes, self.heartbeat, self.status = max_file_bytes, heartbeat, status

    def path(self, generation: int, batch_id: int) -> str:
        return f"{self.folder}/g{generation:04d}-b{batch_id:09d}"

    def _numbered(self, spark: SparkSession, folder: str, last: int) -> int:
        """Names a batch's files by numbers from ``last`` on, brings them to disk, and returns the last number."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(folder)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for old in sorted(f.getPath().getName() for f in files.listStatus(at) if f.getPath().getName().startswith("part-")):
            last += 1
            new = f"{self.prefix}-{last:06d}.jsonl"
            if not files.rename(hadoop.Path(at, old), hadoop.Path(at, new)):
                raise StateError(f"{folder}/{old} could not be named {new}")
            if (on_disk := local(folder)) is not None:  # other file systems keep what a closed file holds
                _sync(Path(on_disk, new))
        if (on_disk := local(folder)) is not None:
            _sync(Path(on_disk))
        return last

    def __call__(self, changes: DataFrame, batch_id: int) -> None:
        state = self.state.check(self.identity)
        own = ["owner", "table_name", "object_id", "row_id", "scn", "before", "after", "ddl_kind", "ddl_text"]
        order = ["commit_scn", "container", "xid", "pos"]
        changes.persist()
        try:
            size = F.octet_length(F.coalesce("after", F.lit(""))) + F.octet_length(F.coalesce("before", F.lit(""))) + F.octet_length(F.coalesce("ddl_text", F.lit(""))) + 300
            found = changes.agg(F.max("commit_scn").alias("scn"), F.sum(size.cast("long")).alias("bytes")).first()
            rows = messages(changes, own)
            if self.heartbeat:
                scn = found["scn"] if found["scn"] is not None else state.safe_scn
                rows = rows.unionByName(rows.sparkSession.range(1).select(F.lit("chkpt").alias("kind"), F.lit(scn).alias("commit_scn")), allowMissingColumns=True)
            parts = max(1, -(-int(found["bytes"] or 0) // self.max_file_bytes))
            db = F.coalesce("container", F.lit(self.database).cast("string")).alias("db")
            line = to_json(F.struct("kind", *order, db, "op", *own))
            ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            ordered.select(line.alias("value")).write.mode("overwrite").text(self.path(state.generation, batch_id))
            state.files = self._numbered(changes.sparkSession, self.path(state.generation, batch_id), state.files)
        finally:
            changes.unpersist()
        state.counted[str(state.generation)] = batch_id
        state.safe_scn = max(state.safe_scn, found["scn"] if found["scn"] is not None else -1)
        self.state.save(state)
        if self.status:
            _atomic(Path(self.status), json.dumps({"batch": batch_id, "safe_scn": state.safe_scn, "files": state.files, "at": time.time()}))


def delivered(spark: SparkSession, folder: str, state: StateFile) -> DataFrame:
    """The lines that count, as ``value`` with ``batch`` and ``part``, to be sorted by these for commit order."""
    counted = {int(g): n for g, n in state.load().counted.items() if n >= 0}
    if not counted:
        return spark.createDataFrame([], "value string, batch string, part string")
    lines = spark.read.text([f"{folder}/g{g:04d}-b*" for g in sorted(counted)]).withColumn("file", F.input_file_name())
    lines = lines.select("value", F.regexp_extract("file", r"(g\d+-b\d+)/", 1).alias("batch"), F.regexp_extract("file", r"([^/]*)$", 1).alias("part"))
    number = F.regexp_extract("batch", r"b(\d+)", 1).cast("long")
    last = F.coalesce(*[F.when(F.col("batch").startswith(f"g{g:04d}-"), n) for g, n in counted.items()])
    return lines.where(number <= last)


def rewind(state: StateFile, target: int) -> State:
    """State for a run from an earlier position: old output stays, new batches get a new generation.

    The new run delivers, whole, the transactions that committed after ``target``, whenever they
    began. The job must be stopped, and the new run needs a new checkpoint folder.
    """
    now = state.load()
    if target > now.safe_scn:
        raise StateError(f"cannot rewind to {target}: only positions up to {now.safe_scn} are durable")
    now.generation += 1
    now.safe_scn = now.floor = target
    state.save(now)
    return now


def backup(state_folder: str, to: str) -> None:
    """Copies state (no output) to a folder that must not exist."""
    shutil.copytree(state_folder, to)


def restore(copy: str, state_folder: str, identity: dict) -> None:
    """Brings a copy back, if it belongs to the database with this identity."""
    StateFile(copy).check(identity)
    if os.path.exists(state_folder):
        shutil.rmtree(state_folder)
    shutil.copytree(copy, state_folder)
