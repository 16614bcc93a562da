"""Change-log operators against plain Python."""

import random

import pytest
from conftest import SMALL
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import types
from tidemark.operators import checks, order, positions, rolling, schemas, scope, transactions
from tidemark.sources.records import SCHEMA


def log(spark, rows):
    """Records from ``(xid, op, savepoint_scn)``, positions in order."""
    full = [(1, 0, i, 0, i, x, op, "C", "O", "T", 1, None, None, sp, None, "v", None, None) for i, (x, op, sp) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def plain_committed(rows):
    open_, out = {}, []
    for scn, (x, op, sp) in enumerate(rows):
        if op == "COMMIT":
            out += [(scn, x, i, s) for i, s in enumerate(open_.pop(x, []), 1)]
        elif op == "ROLLBACK":
            open_.pop(x, None)
        elif op == "SAVEPOINT_RB":
            open_[x] = [s for s in open_.get(x, []) if s <= sp]
        else:
            open_.setdefault(x, []).append(scn)
    return sorted(out)


def random_log(rng, n):
    rows, ended = [], set()
    for scn in range(n):
        free = [x for x in "abcd" if x not in ended]
        if not free:
            break
        x = rng.choice(free)
        op = rng.choices(["INSERT", "UPDATE", "DELETE", "SAVEPOINT_RB", "COMMIT", "ROLLBACK"], [5, 3, 2, 2, 0.6, 0.3])[0]
        if op in ("COMMIT", "ROLLBACK"):
            ended.add(x)
        rows.append((x, op, rng.randint(0, scn) if op == "SAVEPOINT_RB" else None))
    return rows


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_output_is_committed_minus_undone(spark, seed):
    rows = random_log(random.Random(seed), 60)
    got = transactions.committed(log(spark, rows)).select("commit_scn", "xid", "pos", "scn").collect()
    assert sorted(map(tuple, got)) == plain_committed(rows)


def test_outcomes_and_sizes(spark):
    rows = [("a", "INSERT", None), ("b", "INSERT", None), ("a", "COMMIT", None), ("c", "UPDATE", None), ("b", "ROLLBACK", None)]
    got = {r.xid: (r.first_scn, r.end_scn, r.n_records, r.outcome) for r in transactions.outcomes(log(spark, rows)).collect()}
    assert got == {"a": (0, 2, 2, "COMMIT"), "b": (1, 4, 2, "ROLLBACK"), "c": (3, 3, 1, "OPEN")}
    assert transactions.outcomes(log(spark, rows).limit(0)).count() == 0
    assert {r.xid: r.spills for r in transactions.sizes(log(spark, rows), 1, 10**9).collect()} == dict.fromkeys("abc", True)


def test_messages_complete_once(spark):
    rows = [("a", "INSERT", None), ("b", "DELETE", None), ("b", "COMMIT", None), ("a", "UPDATE", None), ("a", "COMMIT", None)]
    out = transactions.messages(transactions.committed(log(spark, rows)))
    lines = [(r.kind, r.xid) for r in out.orderBy("commit_scn", "xid", "pos").collect()]
    assert lines == [("begin", "b"), ("dml", "b"), ("commit", "b"), ("begin", "a"), ("dml", "a"), ("dml", "a"), ("commit", "a")]
    cut = out.where("not (kind = 'commit' and xid = 'a')")
    assert {r.xid for r in transactions.complete(cut).collect()} == {"b"}
    assert transactions.once(out.union(out)).count() == out.count()
    marked = transactions.with_heartbeat(out, spark.createDataFrame([(9,)], "scn long"), True)
    assert marked.where("kind = 'chkpt'").count() == 1


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_ordered_computations(spark, width):
    rng = random.Random(width)
    keys = sorted(rng.sample(range(-50, 100), 60))
    rows = [(k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "k long, v long")
    total, want = 0, {}
    for k, v in rows:
        total += v
        want[k] = total
    assert {r.k: r.s for r in order.running_sum(df, "k", F.col("v"), "s", width).collect()} == want
    assert {r.k: r.m for r in order.suffix_min(df, "k", "v", "m", width).collect()} == {k: min(v for q, v in rows if q >= k) for k, _ in rows}
    twice = df.union(df)
    assert {(r.k, r.d) for r in order.dense_rank(twice, "k", "d", width).collect()} == {(k, i) for i, k in enumerate(keys, 1)}


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_low_watermark(spark, width):
    rng = random.Random(width)
    txns = [("C", f"x{i}", a := rng.randint(0, 80), a + rng.randint(0, 30), 2, rng.choice(["COMMIT", "ROLLBACK", "OPEN"])) for i in range(30)]
    durable = spark.createDataFrame([(1, i, i, i * 10) for i in range(12)], "thread int, sequence long, lwn long, durable_scn long")
    frame = spark.createDataFrame(txns, "container string, xid string, first_scn long, end_scn long, n_records long, outcome string")
    got = {r.durable_scn: r.low_watermark for r in positions.low_watermarks(durable, frame, width).collect()}
    assert got == {d: min((t[2] for t in txns if t[2] <= d and (t[5] == "OPEN" or d < t[3])), default=None) for d in range(0, 120, 10)}


def test_messages_compute_changes_once(spark):
    """A branch for begins and commits beside the changes' would put all of their sorts in one task."""
    from tidemark.plans.queries import dedupe_replay

    rows = transactions.committed(log(spark, [("a", "INSERT", None), ("a", "DDL", None), ("a", "COMMIT", None), ("b", "INSERT", None), ("b", "COMMIT", None)]))
    got = transactions.messages(rows.where("xid = 'b' or pos > 1"), ["after"]).select("kind", "commit_scn", "xid", "pos", "op", "after").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[2], r[3])) == [
        ("begin", 2, "a", 0, None, None), ("ddl", 2, "a", 2, "DDL", "v"), ("commit", 2, "a", 3, None, None),
        ("begin", 4, "b", 0, None, None), ("dml", 4, "b", 1, "INSERT", "v"), ("commit", 4, "b", 2, None, None),
    ]
    for plan in (transactions.messages(rows), dedupe_replay(spark, "/root/testdata/sf0.001")):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1


def test_a_commit_of_nothing_has_no_rank(spark):
    rows = [("a", "INSERT", None), ("a", "COMMIT", None), ("b", "INSERT", None), ("b", "SAVEPOINT_RB", 0), ("b", "COMMIT", None), ("c", "INSERT", None), ("c", "COMMIT", None)]
    got = transactions.in_commit_order(log(spark, rows)).select("commit_rank", "xid").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "c")]


def test_positions(spark):
    logs = spark.createDataFrame([(1, s) for s in (1, 2, 5, 6, 6, 9)] + [(2, 7)], "thread int, sequence long")
    assert sorted(map(tuple, positions.sequence_gaps(logs).collect())) == [(1, 2, 5), (1, 6, 9)]
    archives = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "sequence long, first_scn long")
    asked = spark.createDataFrame([(5,), (10,), (29,), (99,)], "scn long")
    assert sorted(map(tuple, positions.archive_for(archives, asked).collect())) == [(5, None), (10, 1), (29, 2), (99, 3)]
    ties = spark.createDataFrame([(4, 10), (3, 10), (9, None)], "sequence long, first_scn long")
    assert sorted(map(tuple, positions.archive_for(ties, asked.union(spark.sql("select cast(null as long)"))).collect()), key=str) == [(10, 4), (29, 4), (5, None), (99, 4), (None, None)]
    threads = spark.createDataFrame([(1, 4, 10), (1, 3, 5), (2, 1, None), (2, 2, 8)], "thread int, sequence long, first_scn long")
    assert sorted(map(tuple, positions.earliest_archive(threads).collect())) == [(1, 3, 5), (2, 2, 8)]
    assert positions.start_position(None, None, 7) == 7 and positions.start_position(None, 3, 7) == 3 and positions.start_position(5, 3, 7) == 5
    with pytest.raises(ValueError, match="lose changes"):
        positions.start_position(5, 6, 7)
    with pytest.raises(ValueError, match="cannot rewind"):
        positions.rewind_target(6, 5)
    rows = log(spark, [("a", "INSERT", None), ("b", "INSERT", None), ("a", "COMMIT", None)])
    assert [r.xid for r in positions.begun_before(rows, 2).collect()] == ["a"]
    assert positions.from_position(rows, 2).count() == 1


def test_schema_history(spark):
    history = spark.createDataFrame([(1, 10, "v1", False), (1, 20, "v2", False), (1, 30, None, True), (2, 5, "w", None)], "object_id long, effective_scn long, structure string, tombstone boolean")
    changes = spark.createDataFrame([(1, s) for s in (9, 10, 19, 20, 35)] + [(2, 6), (3, 1)], "object_id long, scn long")
    got = {(r.object_id, r.scn): r.structure for r in schemas.as_of(changes, history).collect()}
    assert got == {(1, 9): None, (1, 10): "v1", (1, 19): "v1", (1, 20): "v2", (1, 35): None, (2, 6): "w", (3, 1): None}
    assert {(r.object_id, r.effective_scn): r.valid_to for r in schemas.validity(history).collect()} == {(1, 10): 20, (1, 20): 30, (1, 30): None, (2, 5): None}
    assert [r.object_id for r in schemas.latest_tables(history).collect()] == [2]
    tried = schemas.with_fallbacks(changes, history.where("object_id = 2"), history)
    assert {(r.object_id, r.scn): r.source_no for r in tried.collect()}[(1, 19)] == 1
    with pytest.raises(Exception, match="no structure is proved for object"):
        schemas.proved(tried).collect()
    assert len(schemas.proved(tried.where("structure is not null")).collect()) == 4


@pytest.mark.parametrize("width", [None, 2, 7, 1000])
def test_a_drop_is_knowledge(spark, width):
    rows = "object_id long, effective_scn long, structure string, tombstone boolean"
    first, second = spark.createDataFrame([(1, 5, "A", False), (1, 10, None, True)], rows), spark.createDataFrame([(1, 5, "OLD", False), (2, 3, "B", False)], rows)
    changes = spark.createDataFrame([(1, 4), (1, 7), (1, 20), (2, 3), (2, 2), (None, 9)], "object_id long, scn long")
    got = {(r.object_id, r.scn): (r.structure, r.source_no) for r in schemas.with_fallbacks(changes, first, second, width=width).collect()}
    assert got == {(1, 4): (None, None), (1, 7): ("A", 0), (1, 20): (None, 0), (2, 3): ("B", 1), (2, 2): (None, None), (None, 9): (None, None)}


def test_hot_objects_are_cut_by_ranges(spark, monkeypatch):
    """Nine of ten changes are of one object; ranges come from the data."""
    monkeypatch.setattr(order, "ROWS", 50)
    rng = random.Random(6)
    versions = sorted(rng.sample(range(3000), 60))
    history = spark.createDataFrame([(1 if i % 3 else 2, s, f"v{s}", False) for i, s in enumerate(versions)], "object_id long, effective_scn long, structure string, tombstone boolean")
    points = [(1 if rng.random() < 0.9 else 2, rng.randrange(3000) ** 2 // 3000) for _ in range(2000)]
    changes = spark.createDataFrame(points, "object_id long, scn long")
    assert len(order.cuts(changes, "scn")) > 20
    found = {(r.object_id, r.scn): r.version_scn for r in schemas.as_of(changes, history).collect()}
    own = {1: [s for i, s in enumerate(versions) if i % 3], 2: versions[::3]}
    assert found == {(o, s): max((v for v in own[o] if v <= s), default=None) for o, s in points}


def test_ddl(spark):
    ddl = spark.createDataFrame(
        [
            (1, 30, "ALTER", '{"drop": ["A"], "rename": {"B": "C"}}'), (1, 10, "CREATE", '{"columns": [{"name": "A"}, {"name": "B"}]}'),
            (1, 20, "TRUNCATE", None), (1, 40, "DROP", None), (1, 50, "CREATE", '{"columns": [{"name": "Z"}]}'),
        ],
        "object_id long, scn long, ddl_kind string, ddl_text string",
    )
    got = {r.effective_scn: (r.structure, r.tombstone) for r in schemas.fold_ddl(ddl).collect()}
    assert got[20] == ('[{"name": "A"}, {"name": "B"}]', False) and got[30] == ('[{"name": "C"}]', False)
    assert got[40] == (None, True) and got[50] == ('[{"name": "Z"}]', False)
    with pytest.raises(ValueError, match="unknown kind"):
        schemas.apply_ddl([], "MERGE", {})


def test_pieces(spark):
    pieces = spark.createDataFrame([("r", 2, {"B": "y"}), ("r", 1, {"A": "x", "B": "old"})], "row string, no int, values map<string,string>")
    assert schemas.merge_pieces(pieces, ["row"], "no").first()["values"] == {"A": "x", "B": "y"}
    lobs = spark.createDataFrame([(1, 2, bytearray(b"cd")), (1, 1, bytearray(b"ab"))], "id long, no int, data binary")
    assert bytes(schemas.assemble_lob(lobs, ["id"], "no", "data", binary=True).first().data) == b"abcd"
    parts = spark.createDataFrame([(11, 1)], "object_id long, parent_id long")
    rows = spark.createDataFrame([(11,), (12,)], "object_id long")
    assert sorted(r.object_id for r in schemas.to_logical_table(rows, parts).collect()) == [1, 12]


def test_scope(spark):
    names = spark.createDataFrame([("P", "A", "T1"), (None, "A", "T1"), ("P", "B", "T1X")], "container string, owner string, table_name string").withColumn("name", scope.full_name())
    assert [r.name for r in names.where(scope.in_scope(F.col("name"), [r"P\..*\.T1", r"A\.T1"])).collect()] == ["P.A.T1", "A.T1"]
    assert [r.name for r in names.where(scope.in_scope(F.col("name"), [".*"], [r"P\..*"])).collect()] == ["A.T1"]
    with pytest.raises(Exception):
        scope.one_pattern(["("])
    with pytest.raises(ValueError, match="leave its folder"):
        scope.mapped_path(F.lit("x"), {"/a/../b": "/c"})
    paths = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/z",)], "p string")
    assert [r[0] for r in paths.select(scope.mapped_path(F.col("p"), {"/a": "/1", "/a/b": "/2"})).collect()] == ["/2/c", "/1/x", None]
    with pytest.raises(Exception, match="cannot capture"):
        scope.capturable(spark.createDataFrame([("SYSTEM",)], "kind string")).collect()


@pytest.mark.parametrize(("limit", "width"), [(1, 5), (10, 3), (37, 1 << 20), (10_000, 7)])
def test_rolling_files(spark, limit, width):
    rng = random.Random(limit)
    sizes = [rng.choice([0, 1, 5, 9, 40]) for _ in range(80)]
    n, filled, want = 1, 0, {}
    for i, s in enumerate(sizes):
        if filled >= limit:
            n, filled = n + 1, 0
        filled += s
        want[3 * i] = n
    rows = spark.createDataFrame([(3 * i, s) for i, s in enumerate(sizes)], "k long, size long")
    assert {r.k: r.file_no for r in rolling.files(rows, "k", "size", limit, width).collect()} == want
    assert rolling.files(rows.limit(0), "k", "size", limit, width).count() == 0


def test_numbers_and_types(spark):
    texts = {"1e3": "1000", "-1.50": "-1.5", "0.00": "0", "1e-3": "0.001", "12345678901234567890123456789012345678901234567890": "12345678901234567890123456789012345678901234567890", "-0": "0", "1.25E1": "12.5", "00012": "12", ".5": "0.5", "x": None, "9.99e-2": "0.0999"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in rows.withColumn("n", types.number_text(F.col("t"))).collect()} == texts
    one = spark.range(1)
    got = one.select(
        types.typed(2, F.lit("12.340"), 5, 2).cast("string").alias("a"), types.typed(12, F.lit("2024-02-29 23:59:59")).alias("b"), types.typed(23, F.lit("6162")).alias("c"),
        types.typed(101, F.lit("NaN")).alias("d"), types.typed(181, F.lit("2024-01-01 00:00:00 +02:00")).alias("e"), types.typed(182, F.lit("1-2")).cast("string").alias("f"),
        types.typed(183, F.lit("1 02:03:04.5")).alias("g"), types.typed(252, F.lit("true")).alias("h"), types.typed(999, F.lit("x")).alias("i"), types.typed(231, F.lit("2024-01-01 00:00:00")).alias("j"),
    ).first()
    assert got.a == "12.34" and str(got.b) == "2024-02-29 23:59:59" and bytes(got.c) == b"ab" and got.d != got.d and got.e.zone == "+02:00"
    assert got.f == "INTERVAL '1-2' YEAR TO MONTH" and got.g.total_seconds() == 93784.5 and got.h is True and got.i == "?"
    for code, text, more in ((2, "1.23456", (20, 4)), (180, "2024-01-01 00:00:00.123456789", ()), (181, "2024-01-01 00:00:00.1234567 Z", ()), (2, "x", (5, 2))):
        with pytest.raises(Exception, match="decimal places|CAST_INVALID_INPUT"):
            one.select(types.typed(code, F.lit(text), *more)).collect()
    kept = one.select(types.to_json(F.struct(F.lit(None).cast("string").alias("a"))).alias("j")).first().j
    assert kept == '{"a":null}'


def test_charsets(spark):
    for name, text in (("ZHS16GBK", "中文"), ("WE8MSWIN1252", "€uro"), ("AL32UTF8", "ß😀"), ("JA16SJIS", "日本")):
        row = spark.createDataFrame([(bytearray(text.encode(types.CODECS[name])),), (None,)], "b binary")
        assert [r[0] for r in row.select(types.decoded_by_python(F.col("b"), name)).collect()] == [text, None]
    with pytest.raises(ValueError, match="unknown character set"):
        types.decoded_by_python(F.lit(b""), "NONE")


def test_checks(spark):
    good = spark.createDataFrame([("19.20", "ARCHIVELOG", "YES", "YES", "YES", "YES", "YES")], "version string, log_mode string, supplemental_log string, force_logging string, paths_mapped string, files_readable string, privileges string")
    checks.require(checks.preflight(good))
    with pytest.raises(checks.PreflightError, match="NOARCHIVELOG"):
        checks.require(checks.preflight(good.withColumn("log_mode", F.lit("NOARCHIVELOG"))))
    ids = spark.createDataFrame([(1, 2, None)], "dbid long, incarnation long, resetlogs string")
    assert checks.same_identity(ids, ids) and not checks.same_identity(ids, ids.withColumn("dbid", F.lit(3)))
    a = spark.createDataFrame([('{"x": 1, "y": [2]}',), ("{}",), ("{}",)], "j string")
    b = spark.createDataFrame([('{"y":[2],"x":1}',), ("{}",)], "j string")
    assert [tuple(r) for r in checks.difference(a, b, ["j"]).collect()] == [("{}", "extra")]


def test_queries_agree_with_sql(spark):
    """Each query's rows against DuckDB over the smallest tables."""
    import os

    import duckdb

    from tidemark.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")

    def shown(rows):
        return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)

    for name, sql in ORACLE_SQL.items():
        mine = QUERIES[name](spark, SMALL)
        columns = ", ".join(f'"{c}"' for c in mine.columns)
        theirs = con.execute(f"select {columns} from ({sql})").fetchall()
        assert shown(mine.collect()) == shown(theirs), name
