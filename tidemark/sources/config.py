"""The configuration of a capture job: read once, checked as a whole."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException


class ConfigError(ValueError):
    """A setting is unknown, missing or wrong."""


@dataclass(frozen=True)
class Output:
    folder: str
    prefix: str = "changes"
    max_file_bytes: int = 256 << 20
    heartbeat: bool = False


@dataclass(frozen=True)
class Source:
    records: str
    poll_interval_seconds: float = 10
    missing_file_timeout_seconds: float = 300
    start_scn: int | None = None
    block_size: int = 8192  # of the logs that whatever decodes them reads
    identity: dict = field(default_factory=dict)  # of the database: dbid, incarnation, resetlogs
    database: str | None = None  # its name, for tables without a container
    metadata: str | None = None  # a JSON record of what the preflight checks


@dataclass(frozen=True)
class Config:
    """``include`` is required; patterns are whole-name regular expressions, and ``exclude`` wins."""

    source: Source
    output: Output
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    mappings: dict[str, str] = field(default_factory=dict)
    state: str = "state"
    stop_seconds: int = 60
    password: str = field(default="", repr=False)

    def fingerprint(self) -> str:
        """The SHA-256 of the settings but the password, in canonical JSON."""
        shown = {k: v for k, v in asdict(self).items() if k != "password"}
        return hashlib.sha256(json.dumps(shown, sort_keys=True).encode()).hexdigest()


def pattern_error(pattern: str) -> str | None:
    """What is wrong with a pattern, which Spark's JVM matches: asked there if a session runs, else only what is wrong in any dialect."""
    if SparkContext._active_spark_context is not None:
        try:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, PySparkException) as e:
            return str(e)
        return None
    try:
        re.compile(re.sub(r"\\[pPQEhHRXzZG](?:\{\w+\})?|(?<=[*+?}])\+", "", pattern))
    except re.error as e:
        return str(e)
    return None


BLOCK_SIZES = (2048, 4096, 8192, 16384, 32768)


def _only(kind: type, given: object, where: str) -> dict:
    if not isinstance(given, dict):
        raise ConfigError(f"{where} must be a group of settings")
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(given) - known):
        raise ConfigError(f"unknown setting in {where}: {', '.join(unknown)}")
    return given


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ConfigError(f"{k} is given twice")
        out[k] = v
    return out


def load(text: str) -> Config:
    """A configuration from JSON text (JSON is also YAML). Anything wrong raises ``ConfigError``."""
    try:
        given = _only(Config, json.loads(text, object_pairs_hook=_no_repeats), "the configuration")
    except json.JSONDecodeError as e:
        raise ConfigError(f"not a configuration: {e}") from e
    try:
        source, output = Source(**_only(Source, given.get("source"), "source")), Output(**_only(Output, given.get("output"), "output"))
        config = Config(**{**given, "source": source, "output": output, "include": tuple(given.get("include", ())), "exclude": tuple(given.get("exclude", ()))})
    except TypeError as e:
        raise ConfigError(str(e)) from e
    if not config.include:
        raise ConfigError("include needs at least one pattern")
    for p in (*config.include, *config.exclude):
        if why := pattern_error(p):
            raise ConfigError(f"bad pattern {p!r}: {why}")
    for path in (*config.mappings, *config.mappings.values(), config.state, config.output.folder):
        if ".." in PurePosixPath(path).parts:
            raise ConfigError(f"a path must not leave its folder: {path}")
    if config.source.block_size not in BLOCK_SIZES:
        raise ConfigError(f"block_size must be one of {BLOCK_SIZES}")
    if config.output.max_file_bytes <= 0:
        raise ConfigError("max_file_bytes must be positive")
    return config
