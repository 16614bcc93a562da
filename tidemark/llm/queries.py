"""The queries of this subpackage, as thin digests of its operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_extract, language_id, mixing, quality_model, quality_rules, secrets, simhash, topk
from .common import table


def tokenizer_file() -> str:
    """The vocabulary's path, TOKENIZER_FILE or that of the installed public files; the same on all executors."""
    if given := os.environ.get("TOKENIZER_FILE"):
        return given
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_records(chat.conversation_records(rows)))


#: Target weights of the sources in the query and the pipeline, in parts of their sum; others get 1.
MIX_WEIGHTS = {"src0": 8, "src1": 6, "src2": 6, "src3": 5, "src4": 5, "src5": 4, "src6": 4, "src7": 4, "src8": 3, "src9": 3, "src10": 3, "src11": 2, "src12": 2, "src13": 2}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grades = labels.select("doc_id", quality_model.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = docs.select("doc_id", "text").join(F.broadcast(quality_model.sampled(grades)), "doc_id")
    return quality_model.rate(docs, quality_model.fit(rated, 3))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (op1_chat, op2_mixing, op3_quality_rules, op4_bpe, op5_secrets, op6_html, op7_simhash, op8_topk, op9_quality_model, op10_language_id)
}

#: SQL for the operators whose whole result SQL can express; tests hold the others against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op1_chat": """
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (select *, role || chr(10) || text || chr(10) as shown, list_sum(list_transform(['\\', '<|', '<s>', '</s>', '[INST]', '[/INST]'],
    lambda c: (length(role || ' ' || text) - length(replace(role || ' ' || text, c, ''))) // length(c))) as escapes from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(shown, '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length(role) + length(text) + escapes + 32)::bigint as formatted_chars
from sized group by conv_id""",
    "op8_topk": """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x::double[], c.x::double[])::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
}
