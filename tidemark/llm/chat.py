"""Chat formatting: records of different layouts become canonical turns and then one text.

A record's layout is told by a fingerprint: the hash of its nested field paths. Each known
fingerprint selects a declarative mapping from its paths to turns. Turns are written by a
template whose control strings are escaped within texts, and can be read back from the result.
Everything is a DataFrame expression.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import let

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What begins a control string of this or other common templates, or an escape: a backslash is put behind it.
_CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])|\\"

TURNS = "array<struct<role:string,text:string>>"
#: The longest string that Spark's JSON parser reads; no shorter record is over its other limits.
PARSED = 20_000_000

#: Mappings: the name, required and optional paths with their types, and turns as SQL over the variant ``v``.
#: ``path(p)`` stands for the text at path p.
MAPPINGS = (
    ("messages", ("messages[].content", "messages[].role"), (), "transform(variant_get(v, '$.messages', 'array<struct<role string, content string>>'), m -> named_struct('role', m.role, 'text', m.content))"),
    ("conversations", ("conversations[].from", "conversations[].value"), (), "transform(variant_get(v, '$.conversations', 'array<struct<from string, value string>>'), m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end, 'text', m.value))"),
    ("prompt", ("prompt", "response"), ("system",), "filter(array(named_struct('role', 'system', 'text', path(system)), named_struct('role', 'user', 'text', path(prompt)), named_struct('role', 'assistant', 'text', path(response))), t -> t.text is not null)"),
    ("completion", ("completion", "prompt"), ("system",), "filter(array(named_struct('role', 'system', 'text', path(system)), named_struct('role', 'user', 'text', path(prompt)), named_struct('role', 'assistant', 'text', path(completion))), t -> t.text is not null)"),
    ("instruction", ("instruction", "output"), ("input", "system"), "filter(array(named_struct('role', 'system', 'text', path(system)), named_struct('role', 'user', 'text', concat_ws('\\n\\n', path(instruction), nullif(path(input), ''))), named_struct('role', 'assistant', 'text', path(output))), t -> t.text is not null)"),
    ("question", ("answer", "question"), ("context",), "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', nullif(path(context), ''), path(question))), named_struct('role', 'assistant', 'text', path(answer)))"),
)


def field_paths(v: Column) -> Column:
    """The nested field paths of a variant, as one sorted text: ``OBJECT<messages: ARRAY<...`` of the
    schema without the types of its leaves, so that equal layouts have equal texts. A leaf whose type
    differs within a list is a leaf like any other."""
    leaf = r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|FLOAT|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(v), leaf, "_")


def _signature(paths: tuple[str, ...]) -> str:
    """The text of ``field_paths`` for a mapping's paths; ``a[].b`` is a field b of the objects in list a."""
    top: dict[str, list[str]] = {}
    for p in paths:
        head, _, tail = p.partition("[].")
        top.setdefault(head, []).extend([tail] if tail else [])
    shown = [f"{h}: ARRAY<OBJECT<{', '.join(f'{t}: _' for t in sorted(ts))}>>" if ts else f"{h}: _" for h, ts in sorted(top.items())]
    return f"OBJECT<{', '.join(shown)}>"


def _schema_paths(t: DataType) -> str:
    """What ``field_paths`` gives for values of a type."""
    if isinstance(t, StructType):
        return f"OBJECT<{', '.join(f'{f.name}: {_schema_paths(f.dataType)}' for f in sorted(t.fields, key=lambda f: f.name))}>"
    return f"ARRAY<{_schema_paths(t.elementType)}>" if isinstance(t, ArrayType) else "_"


def _native_turns(sql: str, names: list[str]) -> Column:
    """The mapping's turns over a struct ``v`` with fields ``names``."""
    sql = re.sub(r"variant_get\(v, '\$\.(\w+)', '[^']*'\)", r"v.`\1`", sql)
    return F.expr(re.sub(r"path\((\w+)\)", lambda m: f"cast({f'v.`{m[1]}`' if m[1] in names else 'null'} as string)", sql))


def _turns(sql: str) -> Column:
    return F.expr(re.sub(r"path\((\w+)\)", r"variant_get(v, '$.\1', 'string')", sql))


def canonical_turns(records: DataFrame, json_col: str) -> DataFrame:
    """``records`` with ``layout`` (a mapping's name, null if none fits), ``fingerprint`` and ``turns``
    (``array<struct<role, text>>``), for records given in ``json_col`` as structs or as JSON text.

    A struct's layout is its schema's and its turns are taken as they are, whatever their size. JSON
    text is parsed as a whole; Spark's parser reads strings of up to 20,000,000 characters and records
    of up to 128 MiB, and the job fails at a longer text that can't be read.
    A null record, one that is no JSON, and one whose layout no mapping knows have null turns.
    Null roles and texts become empty. Columns of these names are replaced.
    """
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    given = records.schema[json_col].dataType
    if isinstance(given, StructType):
        out, paths = records.withColumn("v", F.col(f"`{json_col}`")), F.lit(_schema_paths(given))
    else:
        text = F.col(f"`{json_col}`").cast("string")
        parsed = F.try_parse_json(text)
        over = F.raise_error(F.lit(f"a record is no JSON or over what Spark's parser reads ({PARSED:,} characters a string, 128 MiB)"))
        out = records.withColumn("v", F.when((F.length(text) > PARSED) & parsed.isNull(), over).otherwise(parsed))
        paths = field_paths(F.col("v"))
    out = out.withColumn("fingerprint", F.when(F.col("v").isNotNull(), F.xxhash64(paths)))
    for name, required, optional, sql in MAPPINGS:
        variants = [_signature(required + extra) for n in range(len(optional) + 1) for extra in combinations(optional, n)]
        fits = F.col("fingerprint").isin(*[F.xxhash64(F.lit(x)) for x in variants])
        if isinstance(given, StructType):
            if _schema_paths(given) not in variants:
                continue
            found = _native_turns(sql, given.names)
        else:
            found = _turns(sql)
        layout, turns = F.when(fits, F.lit(name)).otherwise(layout), F.when(fits, found.cast(TURNS)).otherwise(turns)
    turns = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("v")


def conversation_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, record)``: a message record as a struct for each id, its rows ordered by turn, nulls first, then role and text."""
    row = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"),
    )
    grouped = rows.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return grouped.select(id_col, F.struct(messages.alias("messages")).alias("record"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def formatted(turns: Column) -> Column:
    """The turns as one text by the template."""
    one = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE), escaped(t["text"]), F.lit(CLOSE)))
    return F.array_join(one, "")


def read_back(text: Column) -> Column:
    """The turns of a formatted text. Escaped texts hold no control string, so these are the template's."""
    parts = F.filter(F.split(text, r"<\|im_end\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        return let(
            F.split(body, r"<\|im_sep\|>", 2),
            lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text"), F.length(x[1]).alias("size"), F.length(p).alias("whole")),
        )

    return F.transform(parts, turn)


def loss_spans(read: Column, role: str = "assistant") -> Column:
    """``(start, end)`` in the formatted text, code points, end exclusive, of each text of ``role``; from ``read_back``."""
    start = F.aggregate(
        read,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["whole"] + len(CLOSE)).alias("at"),
            F.when(
                t["role"] == role,
                F.concat(a["spans"], F.array(F.struct((a["at"] + t["whole"] - t["size"]).alias("start"), (a["at"] + t["whole"]).alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return start["spans"]


def format_records(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with ``layout, fingerprint, turns, formatted, loss_spans``.

    ``formatted`` of a record without turns is empty, of one without known layout null.
    """
    out = canonical_turns(records, json_col)
    out = out.withColumn("formatted", formatted(F.col("turns")))
    return out.withColumn("loss_spans", loss_spans(read_back(F.col("formatted"))))


def digests(formatted_records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from ``formatted`` and ``loss_spans`` alone: turns, and all text under the loss mask."""
    text = F.col("formatted")
    read = formatted_records.select(
        F.col(id_col),
        F.length(text).cast("long").alias("formatted_chars"),
        F.transform(read_back(text), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "").alias("loss"),
    )
    return read.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
