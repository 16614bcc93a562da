"""The pipeline and its stages against plain Python."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
import regex
from conftest import SMALL
from pyspark.sql import functions as F
from test_near_copies import brute_kept
from test_other_operators import brute_schedule
from test_text_operators import base_rules

from tidemark.llm import quality_rules, queries, secrets


def line_fails(line):
    solid = len(regex.sub(r"[\x20\x09-\x0D]+", "", line))
    if len(line) >= 20 and solid >= 20 and len(regex.findall(r"[#*$%&|<>{}~^=\\]", line)) * 100 > solid * 12:
        return True
    upper, lower = len(regex.findall(r"\p{Lu}", line)), len(regex.findall(r"\p{Ll}", line))
    if ("!!" in line or "??" in line) and len(regex.split("[!?]{2,}", line)) > 3 and upper + lower >= 20 and upper * 100 > (upper + lower) * 70:
        return True
    if len(line) >= 24 and not regex.search("[.,;:!?…。、，；：！？،؛؟।]", line) and len(regex.split(r"[\x20\x09-\x0D]+", line.strip(" "))) >= 12:
        return True
    separators = len(regex.findall("[|»›•·]", line))
    if separators >= 3 and separators * 30 > solid - separators or len(line) <= 20 and line.lower().strip(" ") in quality_rules.NAVIGATION:
        return True
    if len(line) <= 300 and any(regex.search(rf"\b{p}", line.lower(), regex.ASCII) for p in quality_rules.BOILERPLATE):
        return True
    return len(line) >= 24 and len(regex.sub(r"(?<!\S)(\S+)(?: \1){2,}(?!\S)", "", line)) * 2 < len(line)


def plain_stages(docs):
    """``docs``: (doc_id, text, source) rows; what each stage leaves, and the mixture's order at the last."""
    kept = []
    for i, text, source in docs:
        n_words, word_chars, *_, failed = base_rules(text)
        cleaned = "\n".join(x for x in (text or "").split("\n") if not line_fails(x))
        lost = word_chars - len(regex.sub(r"[\x20\x09-\x0D]+", "", cleaned))
        if not failed and 100 * lost <= 50 * word_chars:
            kept.append((i, cleaned, source))
    kept.sort()
    stay = brute_kept({i: t for i, t, _ in kept})
    ones = [x for x in kept if x[0] in stay]
    masked = [(i, secrets.mask(t), s) for i, t, s in ones]
    by = {}
    for i, _, s in masked:
        by.setdefault(s, []).append(i)
    weights = {s: queries.MIX_WEIGHTS.get(s, 1) for s in by}
    order = [i for _, s, b in brute_schedule(weights, {s: -(-len(x) // 64) for s, x in by.items()}) for i in by[s][64 * b : 64 * b + 64]]
    return kept, ones, masked, order


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "source").collect()
    return plain_stages([tuple(r) for r in docs])


def test_stages(spark, plain, tmp_path):
    kept, ones, masked, order = plain
    sf_dir = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, ones, masked, masked), strict=False):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        if name == "mixing":
            assert [r.doc_id for r in out.collect()] == order
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert sorted((r.doc_id, r.text, r.source) for r in rows) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in rows), name


def test_run(spark, plain):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    want = set()
    for i, text, _ in plain[2]:
        ids = library.encode(text, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    rows = corpus_pipeline.run(spark, SMALL.replace("0.001", "0.01")).collect()
    assert {tuple(r)[:4] for r in rows} == want
    # the tokens can be put into the mixture's order
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.place))] == plain[3]


def test_tokens_keep_the_order_of_several_files(spark, tmp_path):
    docs = spark.range(4000).selectExpr("3999 - id as doc_id", "'a b' as text", "'en' as lang", "cast(id % 3 as string) as source", "3L as n_chars")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs.withColumn("_metadata", F.lit("x")).orderBy("doc_id").write.parquet(str(tmp_path / "docs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    assert len({r.shard for r in rows}) > 1
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.place))] == list(range(4000))
    assert all(r.shard is None and r.place is None for r in corpus_pipeline.tokens(spark, docs, "").collect())


def test_texts_go_to_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefgh "), 400).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.secret_scan, corpus_pipeline.tokens):
        spark.conf.unset(key)
        stage(spark, docs, "")
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 20_000_000 and max(found) < 5_000_000, stage.__name__


def test_stages_on_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x " * 30, None, None, 60), (3, "word " * 20_000, "en", "b", 1), (4, "a b", "en", "b", 3), (4, "a b", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "")
            expected = {"quality_rules": 0, "near_dedup": 5, "secret_scan": 6, "mixing": 6, "bpe": 6} if frame is docs else {}
            if name != "near_dedup":
                assert out.count() == expected.get(name, 0), name
            else:
                assert out.count() <= expected.get(name, 0)
