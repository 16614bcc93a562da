"""Chat records beyond the limits of Spark's JSON parser, and records as structs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat


def test_a_long_text_keeps_its_turns(spark):
    n = 20_000_001
    rows = spark.range(2).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, "hello").otherwise(F.repeat(F.lit("x"), n)).alias("text"))
    row = chat.digests(chat.format_records(chat.conversation_records(rows))).first()
    text = "x" * n
    assert tuple(row)[:5] == (1, 2, hashlib.sha256(f"user\nhello\nassistant\n{text}\n".encode()).hexdigest(), n, hashlib.sha256(text.encode()).hexdigest())


def test_json_over_the_limit_fails(spark):
    record = F.concat(F.lit('{"prompt":"a","response":"'), F.repeat(F.lit("x"), 20_000_001), F.lit('"}'))
    with pytest.raises(Exception, match="20,000,000 characters"):
        chat.canonical_turns(spark.range(1).select(record.alias("r")), "r").select("layout", F.size("turns")).collect()


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ("named_struct('messages', array(named_struct('role', 'user', 'content', 'a'), named_struct('role', 'assistant', 'content', null)))", "messages", [("user", "a"), ("assistant", "")]),
        ("named_struct('conversations', array(named_struct('value', 'a', 'from', 'human')))", "conversations", [("user", "a")]),
        ("named_struct('prompt', 'a', 'response', 'b')", "prompt", [("user", "a"), ("assistant", "b")]),
        ("named_struct('system', 's', 'prompt', 'a', 'completion', 'b')", "completion", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ("named_struct('instruction', 'do', 'input', 'this', 'output', 'done')", "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ("named_struct('other', 1)", None, None),
    ],
)
def test_struct_layouts(spark, record, layout, turns):
    frame = spark.range(1).select(F.expr(record).alias("r"))
    row = chat.canonical_turns(frame, "r").first()
    assert row.layout == layout and (row.turns and [tuple(t) for t in row.turns]) == turns
    assert row.fingerprint == chat.canonical_turns(frame.select(F.to_json("r", {"ignoreNullFields": "false"}).alias("r")), "r").first().fingerprint
