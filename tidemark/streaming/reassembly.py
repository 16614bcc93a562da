"""Transactions rebuilt from a stream of interleaved records.

What a call of the stateful operator costs, in Python and between Python and the JVM, is paid by the
row and by the state it touches. So records reach it in chunks, those of one transaction that lie
near each other in the log as one row, changes leave it in pieces, and what ends in the batch in which it began
touches no state. A record's values are one text on the way, made and taken apart by Spark (see ``_text``).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.transactions import CHANGES, TERMINAL

#: What a record carries, and the types of it; the operator itself looks at the first four.
_CHANGE = ("scn long", "block_offset long", "op string", "savepoint_scn long", "owner string", "table_name string", "object_id long", "row_id string", "before string", "after string", "ddl_kind string", "ddl_text string")
_TYPES = dict(f.split() for f in _CHANGE)
_NAMES = tuple(_TYPES)
_CARRIED = [n for n in _NAMES if n not in ("block_offset", "savepoint_scn")]

KEPT = (*CHANGES, "SAVEPOINT_RB")
#: Key of a transaction, built without a session, as workers have none.
_XID = StructType([StructField("container", StringType()), StructField("xid", StringType())])
CHUNK = "container string, xid string, records array<string>"
PIECE = "container string, xid string, commit_scn long, first long, changes array<string>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Into how many buckets transactions fall; a checkpoint is good for this number only.
BUCKETS = 1024
#: Changes, and characters of them, that make a piece.
_MOST, _TEXT = 1024, 1 << 20
#: Between a record's values, and for a null one. In a value ``\\e`` stands for a backslash and ``\\u`` for the separator.
_BETWEEN, _NULL = "\x1f", "\\0"


def _text() -> Column:
    """A record's values as one text."""
    values = [F.replace(F.replace(F.col(n).cast("string"), F.lit("\\"), F.lit("\\e")), F.lit(_BETWEEN), F.lit("\\u")) for n in _NAMES]
    return F.concat_ws(_BETWEEN, *[F.coalesce(v, F.lit(_NULL)) for v in values])


def _value(values: Column, name: str) -> Column:
    """A record's value from its text's parts."""
    v = F.get(values, F.lit(_NAMES.index(name)))
    plain = F.replace(F.replace(v, F.lit("\\u"), F.lit(_BETWEEN)), F.lit("\\e"), F.lit("\\"))
    return F.when(v != _NULL, plain).cast(_TYPES[name]).alias(name)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each transaction in a batch as one row."""
    for b in batches:
        if not b.num_rows:
            continue
        codes = [b.column(n).dictionary_encode(null_encoding="encode") for n in ("container", "xid")]
        of = np.asarray(codes[0].indices, "int64") * len(codes[1].dictionary) + np.asarray(codes[1].indices, "int64")
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        ends = pa.array(np.append(starts, len(order)), pa.int32())
        first = pa.array(order[starts])
        records = pa.ListArray.from_arrays(ends, b.column("record").take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([b.column("container").take(first), b.column("xid").take(first), records], ["container", "xid", "records"])


def _in_order(records: Iterable[str]) -> list[tuple[int, int, str, str, str]]:
    """By position: a record's position, place at it, operation, savepoint and whole text."""
    split = ((r.split(_BETWEEN, 4), r) for r in records)
    return sorted(((int(v[0]), 0 if v[1] == _NULL else int(v[1]), v[2], v[3], r) for v, r in split), key=itemgetter(0, 1))


def _pieces(records: Iterable[str]) -> Iterator[list[str]]:
    """``records`` in lists of bounded length and text."""
    some, text = [], 0
    for r in records:
        some.append(r)
        text += len(r)
        if len(some) == _MOST or text >= _TEXT:
            yield some
            some, text = [], 0
    if some:
        yield some


class Reassembly(StatefulProcessor):
    """Keeps a transaction's records until it ends; a commit emits its live changes, a rollback nothing.

    A key of the operator is a bucket of transactions. ``open`` counts the portions that a transaction has in the
    state, ``portions`` has each as JSON text, numbered from 0. A batch adds portions of what it leaves open, so a large transaction
    lies in the state store and only its end brings it together. Nothing is ever evicted: open transactions are data. Records
    that are neither changes, savepoint rollbacks nor ends (such as a begin) are no part of it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", _XID, StructType([StructField("portions", LongType())]))
        self.portions = handle.getMapState("portions", StructType([*_XID, StructField("at", LongType())]), StructType([StructField("records", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new: dict[tuple, list] = {}
        for chunk in rows:
            new.setdefault((chunk.container, chunk.xid), []).extend(chunk.records)
        stored = {tuple(of): n for of, (n,) in self.open.iterator()}
        while new:
            of, records = new.popitem()
            yield from self._continued(of, stored.get(of, 0), records)

    def _continued(self, of: tuple, stored: int, new: list[str]) -> Iterator[Row]:
        """A transaction, of which ``stored`` portions are in the state, with its new records."""
        left: list[str] = []
        for scn, _, op, _, text in _in_order(new):
            if op not in TERMINAL:
                left.append(text)
                continue
            if op == "COMMIT":
                earlier = (json.loads(self.portions.getValue((*of, i))[0]) for i in range(stored))
                yield from _live(of, scn, [*itertools.chain.from_iterable(earlier), *left])
            for i in range(stored):
                self.portions.removeKey((*of, i))
            if stored:
                self.open.removeKey(of)
            stored, left = 0, []
        for some in _pieces(left):
            self.portions.updateValue((*of, stored), (json.dumps(some),))
            stored += 1
        if left:
            self.open.updateValue(of, (stored,))

    def close(self) -> None:
        pass


def _live(of: tuple, commit_scn: int, records: list[str]) -> Iterator[Row]:
    """What a commit delivers of a transaction's records."""
    kept: list[tuple[int, str]] = []
    for scn, _, op, savepoint, text in _in_order(records):
        if op != "SAVEPOINT_RB":
            kept.append((scn, text))
            continue
        while kept and kept[-1][0] > int(savepoint):
            kept.pop()
    first = 1
    for some in _pieces(text for _, text in kept):
        yield Row(container=of[0], xid=of[1], commit_scn=commit_scn, first=first, changes=some)
        first += len(some)


def reassembled(records: DataFrame) -> DataFrame:
    """Committed changes of a stream of records; needs the RocksDB state store (see ``ROCKSDB``)."""
    chunks = records.where(F.col("op").isin(*KEPT, *TERMINAL)).select("container", "xid", _text().alias("record")).mapInArrow(_chunks, CHUNK)
    pieces = chunks.withColumn("bucket", F.pmod(F.xxhash64("container", "xid"), F.lit(BUCKETS))).groupBy("bucket").transformWithState(Reassembly(), PIECE, "Append", "none")
    changes = pieces.select("container", "xid", "commit_scn", "first", F.posexplode("changes").alias("at", "change"))
    changes = changes.select("container", "xid", "commit_scn", (F.col("first") + F.col("at")).alias("pos"), F.split("change", _BETWEEN).alias("values"))
    return changes.select("container", "xid", "commit_scn", "pos", *[_value(F.col("values"), n) for n in _CARRIED])
