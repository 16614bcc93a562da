"""Table structures by log position.

History rows: ``object_id, effective_scn, structure, tombstone`` and whatever else they carry.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import last_known


def validity(history: DataFrame) -> DataFrame:
    """``history`` with ``valid_to``: the position from which the object's next version holds, or null."""
    return history.withColumn("valid_to", F.lead("effective_scn").over(Window.partitionBy("object_id").orderBy("effective_scn")))


def _known(changes: DataFrame, histories: Sequence[DataFrame], columns: Sequence[str], width: int | None) -> DataFrame:
    """``changes`` with ``version 0``, ``version 1``, ...: what each history last said of the object at the position."""
    none = F.lit(None).cast("int")
    both = changes.withColumns({"side": F.lit(1), "history": none})
    for i, h in enumerate(histories):
        version = F.struct(F.col("effective_scn").alias("version_scn"), F.coalesce("tombstone", F.lit(False)).alias("tombstone"), *columns)
        points = h.select("object_id", F.col("effective_scn").alias("scn"), F.lit(0).alias("side"), F.lit(i).alias("history"), version.alias("version"))
        both = both.unionByName(points, allowMissingColumns=True)
    values = {f"version {i}": F.when(F.col("history") == i, F.col("version")) for i in range(len(histories))}
    return last_known(both, ["object_id"], ["scn", "side"], values, width).where("side = 1")


def as_of(changes: DataFrame, history: DataFrame, columns: Sequence[str] = ("structure",), width: int | None = None) -> DataFrame:
    """Each change with the version in force at its position: the nearest at or before it.

    Versions and changes are merged by object and position and the last version is carried on, so
    nothing is paired; an object with a large share of all changes is cut by ranges of positions. Changes
    before any version, or after a tombstone, get null columns and ``version_scn`` null.
    """
    found = _known(changes, [history], columns, width)
    version = F.col("`version 0`")
    live = ~F.coalesce(version["tombstone"], F.lit(False))
    return found.select(*changes.columns, *[F.when(live, version[c]).alias(c) for c in ("version_scn", *columns)])


def with_fallbacks(changes: DataFrame, *histories: DataFrame, width: int | None = None) -> DataFrame:
    """The structure in force, from histories in order of trust: the first that knows the object at the position decides.

    ``source_no`` tells which. That an object was dropped is knowledge too: its structure is null then, and no later
    history is asked. Rows that none knows have both null. Neither may be delivered: see ``proved``.
    """
    found = _known(changes, histories, ("structure",), width)
    versions = [F.col(f"`version {i}`") for i in range(len(histories))]
    pick = F.coalesce(*[F.when(v.isNotNull(), F.lit(i)) for i, v in enumerate(versions)])
    first = F.coalesce(*versions)
    value = F.when(~first["tombstone"], first["structure"])
    return found.select(*changes.columns, value.alias("structure"), pick.alias("source_no"))


def proved(resolved: DataFrame) -> DataFrame:
    """``resolved``, failing at run time on a change whose structure nothing proves, or whose object was dropped."""
    message = F.concat(F.lit("no structure is proved for object "), F.col("object_id").cast("string"), F.lit(" at "), F.col("scn").cast("string"))
    return resolved.withColumn("structure", F.when(F.col("structure").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("structure")))


def initial_snapshot(structures: DataFrame, scn: int) -> DataFrame:
    """History rows of the selected tables' whole structures (``object_id, structure``) when capture begins at ``scn``."""
    return structures.select("object_id", F.lit(scn).cast("long").alias("effective_scn"), "structure", F.lit(False).alias("tombstone"), F.lit("initial").alias("source"))


def by_data_object(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """``changes``, which name a ``data_object_id``, with ``object_id`` as it was at their position.

    ``objects`` has ``data_object_id, object_id, effective_scn``: a truncate or a move gives a table a
    new data object. Changes of data objects that are unknown at their position have null.
    """
    points = objects.select("data_object_id", F.col("effective_scn").alias("scn"), F.lit(0).alias("side"), F.col("object_id").alias("named"))
    both = changes.drop("object_id").withColumn("side", F.lit(1)).unionByName(points, allowMissingColumns=True)
    found = last_known(both, ["data_object_id"], ["scn", "side"], {"object_id": F.col("named")})
    return found.where("side = 1").drop("side", "named")


def apply_ddl(structure: list[dict], kind: str, detail: dict) -> list[dict] | None:
    """The structure after one DDL; None after a drop. TRUNCATE keeps columns."""
    if kind == "CREATE":
        return [dict(c) for c in detail["columns"]]
    if kind == "DROP":
        return None
    if kind == "TRUNCATE":
        return structure
    if kind != "ALTER":
        raise ValueError(f"unknown kind of DDL: {kind}")
    gone = set(detail.get("drop", ()))
    renamed = detail.get("rename", {})
    kept = [{**c, "name": renamed.get(c["name"], c["name"])} for c in structure if c["name"] not in gone]
    return kept + [dict(c) for c in detail.get("add", ())]


def fold_ddl(ddl: DataFrame) -> DataFrame:
    """Committed DDL records ``object_id, scn, ddl_kind, ddl_text (JSON)`` to history rows, one for each record.

    DDL of one object is few; objects are spread over tasks.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        now: list[dict] | None = []
        out = []
        for r in rows.sort_values("scn").itertuples():
            now = apply_ddl(now or [], r.ddl_kind, json.loads(r.ddl_text or "{}"))
            out.append((r.object_id, r.scn, json.dumps(now, sort_keys=True) if now is not None else None, now is None, r.ddl_kind))
        return pd.DataFrame(out, columns=["object_id", "effective_scn", "structure", "tombstone", "ddl_kind"])

    schema = "object_id long, effective_scn long, structure string, tombstone boolean, ddl_kind string"
    return ddl.select("object_id", "scn", "ddl_kind", "ddl_text").groupBy("object_id").applyInPandas(fold, schema)


def captured_from(changes: DataFrame, starts: DataFrame) -> DataFrame:
    """Changes of tables listed in ``starts`` (``object_id, capture_from_scn``) from their own start on.

    A table created later starts at its DDL's commit, one newly included at the then-current
    position; a table taken off the list is not captured.
    """
    return changes.join(starts, "object_id").where(F.col("scn") >= F.col("capture_from_scn")).drop("capture_from_scn")


def relevant_ddl(ddl: DataFrame, selected: DataFrame) -> DataFrame:
    """DDL of selected objects (``object_id``) only."""
    return ddl.join(selected.select("object_id").distinct(), "object_id", "left_semi")


def to_logical_table(changes: DataFrame, partitions: DataFrame) -> DataFrame:
    """Changes of table partitions under their table: ``partitions`` has ``object_id, parent_id``."""
    found = changes.join(partitions, "object_id", "left")
    return found.withColumn("object_id", F.coalesce("parent_id", "object_id")).drop("parent_id")


def merge_pieces(pieces: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Row pieces (``values`` map) to whole rows: of a column in several pieces the last by ``order`` counts."""
    entry = pieces.select(*keys, order, F.explode("values").alias("column", "value"))
    last = entry.groupBy(*keys, "column").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "value")))).alias("values"))


def assemble_lob(pieces: DataFrame, keys: Sequence[str], order: str, data: str, binary: bool = False) -> DataFrame:
    """Large objects from their pieces, in order."""
    parts = F.sort_array(F.collect_list(F.struct(order, data)))
    joined: Column = F.transform(parts, lambda p: p[data])
    empty = F.lit(b"") if binary else F.lit("")
    whole = F.aggregate(joined, empty, lambda a, x: F.concat(a, x)) if binary else F.array_join(joined, "")
    return pieces.groupBy(*keys).agg(whole.alias(data), F.count("*").alias("n_pieces"))


def latest_tables(history: DataFrame) -> DataFrame:
    """The last version of each object that is not dropped."""
    last = history.groupBy("object_id").agg(F.max_by(F.struct("effective_scn", "structure", "tombstone"), "effective_scn").alias("v"))
    return last.select("object_id", "v.*").where(~F.coalesce("tombstone", F.lit(False)))
