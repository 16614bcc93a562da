"""What is captured: names, patterns, path mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import pattern_error

#: Object kinds that cannot be captured.
EXCLUDED_KINDS = ("TEMPORARY", "NESTED", "INTERNAL", "SYSTEM", "MVIEW LOG")


def full_name(container: str = "container", owner: str = "owner", table: str = "table_name") -> Column:
    """``CONTAINER.OWNER.TABLE``, or ``OWNER.TABLE`` without a container."""
    return F.concat_ws(".", container, owner, table)


def database_name(container: str = "container", database: str = "database") -> Column:
    return F.coalesce(F.col(container), F.col(database))


def one_pattern(patterns: Sequence[str]) -> str:
    """A pattern that matches a whole name if any of ``patterns`` does, in the dialect of Spark's JVM. A bad pattern raises ``ValueError``."""
    for p in patterns:
        if why := pattern_error(p):
            raise ValueError(f"bad pattern {p!r}: {why}")
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"


def in_scope(name: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Whether a name matches an include pattern and no exclude pattern, as a whole."""
    if not include:
        raise ValueError("at least one include pattern is needed")
    yes = name.rlike(one_pattern(include))
    return yes & ~name.rlike(one_pattern(exclude)) if exclude else yes


def matching(names: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """Rows whose name matches a pattern of the configured list as a whole; over 10,000 patterns are an error."""
    patterns = patterns.select(pattern).distinct()
    if patterns.count() > 10_000:
        raise ValueError("too many patterns")
    whole = F.concat(F.lit("^(?:"), F.col(pattern), F.lit(")$"))
    return names.join(F.broadcast(patterns), F.rlike(F.col(name), whole), "left_semi")


def mapped_path(path: Column, mappings: Mapping[str, str]) -> Column:
    """``path`` with its longest matching prefix replaced; null if no prefix matches.

    Mappings are configuration, so they become one conditional expression, longest prefix first,
    and no join is needed.
    """
    for source, local in mappings.items():
        if ".." in source.split("/") or ".." in local.split("/"):
            raise ValueError(f"a mapping must not leave its folder: {source} to {local}")
    out = F.lit(None).cast("string")
    for source in sorted(mappings, key=len):
        out = F.when(path.startswith(source), F.concat(F.lit(mappings[source]), F.substr(path, F.lit(len(source) + 1)))).otherwise(out)
    return out


def local_path(path: str, mappings: Mapping[str, str]) -> str:
    """One path by the same rule, itself if no prefix matches."""
    prefix = max((s for s in mappings if path.startswith(s)), key=len, default=None)
    return path if prefix is None else mappings[prefix] + path[len(prefix) :]


def capturable(objects: DataFrame) -> DataFrame:
    """``objects`` (with ``kind``), failing at run time on a kind that cannot be captured."""
    bad = F.upper(F.col("kind")).isin(*EXCLUDED_KINDS)
    message = F.concat(F.lit("cannot capture an object of kind "), F.col("kind"))
    return objects.withColumn("kind", F.when(bad, F.raise_error(message)).otherwise(F.col("kind")))
