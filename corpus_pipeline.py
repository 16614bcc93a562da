"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Stages are
written as Parquet and read again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near_copies, quality_rules, secrets
from tidemark.llm.common import delete, shared_folder, table
from tidemark.llm.queries import MIX_WEIGHTS, tokenizer_file

#: Texts go to the Python workers in batches of so many bytes. A batch is held by the JVM and by the
#: worker at once; of Spark's 64 MB each, for every core, an executor has no room.
BATCH_BYTES = 4 << 20
#: The last stage's tokenizers keep so many pieces, and go with their tasks: workers serve later jobs, too.
KEPT_PIECES = 50_000


def _in_small_batches(spark: SparkSession) -> None:
    """From now on ``BATCH_BYTES`` holds in this session: what a stage returns runs later. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, failing lines of the others too."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a Jaccard similarity of 0.8 or more."""
    _in_small_batches(spark)
    return near_copies.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    _in_small_batches(spark)
    return secrets.masked_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are sorted so that every stretch has the sources' target weights."""
    return mixing.mixed_documents(docs, MIX_WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded texts, with the rows' places in the mixture.

    Sorted by ``shard`` and ``place``, the number of a file and of a row in it, the result is in the
    order in which ``docs`` was written. Both are null for ``docs`` that are not read from files.
    """
    _in_small_batches(spark)
    return bpe.token_digests(docs, tokenizer_file(), keep=_places(docs), kept_pieces=KEPT_PIECES)


def _places(docs: DataFrame) -> dict[str, Column]:
    """``shard`` and ``place`` of the rows of Parquet files: Spark numbers the files of a sorted result in its order."""
    try:
        read = docs.metadataColumn("_metadata")
        docs.select(read)
    except AnalysisException:  # rows from elsewhere
        none = F.lit(None).cast("long")
        return {"shard": none, "place": none}
    return {"shard": F.regexp_extract(read["file_name"], r"part-(\d+)", 1).try_cast("long"), "place": read["row_index"]}


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("secret_scan", secret_scan), ("mixing", mix), ("bpe", tokens)]
#: Lines, fingerprints, structure and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
