"""``python -m tidemark COMMAND CONFIG``: run, start, stop, restart, status, validate, rewind, backup, restore."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import logging.handlers
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

from pyspark.errors import StreamingQueryException

from .sources.config import Config, load
from .sources.records import ChangeRecords
from .streaming.reassembly import ROCKSDB, reassembled
from .streaming.sink import OrderedSink, StateFile, backup, restore, rewind


def logger(config: Config) -> logging.Logger:
    """A rolling log, ten files of 100 MB, compressed; the password never gets into it."""
    import gzip
    import shutil

    class Secret(logging.Filter):
        def filter(self, record: logging.LogRecord) -> bool:
            if config.password:
                record.msg, record.args = record.getMessage().replace(config.password, "***"), ()
            return True

    def packed(source: str, dest: str) -> None:
        with open(source, "rb") as a, gzip.open(dest, "wb") as b:
            shutil.copyfileobj(a, b)
        os.remove(source)

    Path(config.state).mkdir(parents=True, exist_ok=True)
    handler = logging.handlers.RotatingFileHandler(f"{config.state}/tidemark.log", maxBytes=100 << 20, backupCount=10)
    handler.namer, handler.rotator = (lambda n: n + ".gz"), packed
    handler.addFilter(Secret())
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    out = logging.getLogger(f"tidemark.{config.state}")
    out.handlers[:] = [handler]
    out.setLevel(logging.INFO)
    return out


def _checkpoint(config: Config, generation: int) -> str:
    return f"{config.state}/checkpoint-{generation:04d}"


def run(config: Config, spark=None, until_idle: bool = False) -> int:
    """Captures until SIGTERM; the batch under way is finished and committed first."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.checks import preflight, require
    from .operators.positions import start_position
    from .operators.scope import full_name, in_scope, local_path

    log = logger(config)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.dataSource.register(ChangeRecords)
    state = StateFile(config.state)
    if config.source.metadata:
        require(preflight(spark.read.json(config.source.metadata)))
    now = state.check(config.source.identity)
    if now.floor is None:  # a first run
        now.floor = start_position(None, config.source.start_scn, 0) - 1
    else:  # a stored position counts, and a later one would skip changes
        start_position(max(now.safe_scn, now.floor + 1), config.source.start_scn, 0)
    if now.fingerprint and now.fingerprint != config.fingerprint():
        log.warning("the configuration has changed since the last run")
    now.fingerprint = config.fingerprint()
    state.save(now)
    source = spark.readStream.format("change_records").option("path", local_path(config.source.records, config.mappings)).option("timeoutSeconds", config.source.missing_file_timeout_seconds).load()
    wanted = F.col("op").isin("COMMIT", "ROLLBACK", "SAVEPOINT_RB") | in_scope(full_name(), config.include, config.exclude)
    output = config.output
    sink = OrderedSink(
        output.folder, state, config.source.identity, output.max_file_bytes, output.heartbeat, f"{config.state}/status.json", output.prefix, config.source.database
    )
    # a transaction that began before the start and commits after it comes whole
    committed = reassembled(source.where(wanted)).where(F.col("commit_scn") > now.floor)
    writer = committed.writeStream.foreachBatch(sink).option("checkpointLocation", _checkpoint(config, now.generation))
    query = writer.trigger(processingTime=f"{config.source.poll_interval_seconds} seconds").start()
    stopping: list[int] = []
    if not until_idle:
        signal.signal(signal.SIGTERM, lambda *_: stopping.append(1))
    log.info("started at %s", now.safe_scn)
    while query.isActive and not stopping:
        with contextlib.suppress(StreamingQueryException):  # told below
            query.awaitTermination(1)
        if until_idle and query.lastProgress and not query.status["isDataAvailable"] and not query.status["isTriggerActive"] and query.lastProgress["numInputRows"] == 0:
            break
    began = time.monotonic()
    while query.isActive and query.status["isTriggerActive"]:
        if time.monotonic() - began > config.stop_seconds:
            log.error("the batch under way did not end within %s s", config.stop_seconds)
            query.stop()
            return 1
        time.sleep(0.2)
    failed = query.exception()
    query.stop()
    if failed:
        log.error("stopped by an error: %s", failed)
        return 2
    log.info("stopped at %s", state.load().safe_scn)
    return 0


def _pid(config: Config) -> int | None:
    path = Path(config.state, "pid")
    if not path.exists():
        return None
    pid = int(path.read_text())
    try:
        os.kill(pid, 0)
    except OSError:
        return None
    return pid


def start(config: Config, config_path: str) -> int:
    if _pid(config):
        print("already running", file=sys.stderr)
        return 1
    Path(config.state).mkdir(parents=True, exist_ok=True)
    job = subprocess.Popen([sys.executable, "-m", "tidemark", "run", config_path], start_new_session=True)
    Path(config.state, "pid").write_text(str(job.pid))
    return 0


def stop(config: Config) -> int:
    """SIGTERM, and up to the configured seconds of waiting; never a kill."""
    pid = _pid(config)
    if pid is None:
        return 0
    os.kill(pid, signal.SIGTERM)
    for _ in range(config.stop_seconds * 5):
        if _pid(config) is None:
            return 0
        time.sleep(0.2)
    print(f"{pid} is still running", file=sys.stderr)
    return 1


def status(config: Config) -> dict:
    path = Path(config.state, "status.json")
    return {"running": _pid(config) is not None, "safe_scn": StateFile(config.state).load().safe_scn} | (json.loads(path.read_text()) if path.exists() else {})


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("command", choices=["run", "start", "stop", "restart", "status", "validate", "rewind", "backup", "restore"])
    parser.add_argument("config")
    parser.add_argument("--scn", type=int)
    parser.add_argument("--folder")
    args = parser.parse_args(argv)
    config = load(Path(args.config).read_text())
    stopped = _pid(config) is None
    if args.command in ("rewind", "backup", "restore") and not stopped:
        print("stop the job first", file=sys.stderr)
        return 1
    match args.command:
        case "run":
            return run(config)
        case "start":
            return start(config, args.config)
        case "stop":
            return stop(config)
        case "restart":
            return stop(config) or start(config, args.config)
        case "status":
            print(json.dumps(status(config)))
        case "validate":
            from .operators.scope import local_path

            folder = local_path(config.source.records, config.mappings)
            if not os.path.isdir(folder) or not os.access(folder, os.R_OK):
                print(f"{folder} is no folder that can be read", file=sys.stderr)
                return 1
            if config.source.metadata:
                from pyspark.sql import SparkSession

                from .operators.checks import PreflightError, preflight, require

                try:
                    require(preflight(SparkSession.builder.appName("tidemark").getOrCreate().read.json(config.source.metadata)))
                except PreflightError as e:
                    print(e, file=sys.stderr)
                    return 1
            print("the configuration is valid")
        case "rewind":
            print(f"generation {rewind(StateFile(config.state), args.scn).generation}")
        case "backup":
            backup(config.state, args.folder)
        case "restore":
            restore(args.folder, config.state, config.source.identity)
    return 0


if __name__ == "__main__":
    sys.exit(main())
