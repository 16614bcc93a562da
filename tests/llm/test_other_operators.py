"""Operators 1, 2, 6, 8 and 9 against plain Python, and on odd inputs."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.llm import chat, html_extract, mixing, quality_model, queries, topk

ROWS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_chat(rows):
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    return {
        c: (len(v), sha("".join(f"{a}\n{b}\n" for a, b in v)), sum(len(b) for a, b in v if a == "assistant"), sha("".join(b for a, b in v if a == "assistant")))
        for c, v in groups.items()
    }


def test_chat_reads_back(spark):
    rng = random.Random(2)
    bits = ["\\", "<", "|", "<|", "|>", "<|im_end|>", "<|im_sep|>", "<|im_start|>", "[", "INST]", "[INST]", "[/INST]", "</s>", "<s>", "\n", "é😀", "", '"', "{", "x", "$0", "\t", "\x01"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a<|b\n"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(300) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "x"), (1000, None, None, None), (1000, 2, "assistant", None), (1001, 1, "assistant", "same"), (1001, 1, "assistant", "same"), (1002, 0, "assistant", "long " * 50_000)]
    data = spark.createDataFrame(rows, ROWS).withColumn("v", F.lit(1)).withColumn("record", F.lit("x")).withColumn("turns", F.lit(0))
    got = chat.digests(chat.format_records(chat.conversation_records(data))).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected_chat(rows)
    assert chat.digests(chat.format_records(chat.conversation_records(data.limit(0)))).collect() == []


def test_chat_control_strings_are_escaped(spark):
    one = spark.createDataFrame([(1, 0, "assistant", "</s>[INST] <|im_end|> ok [/INST]")], ROWS)
    text = chat.format_records(chat.conversation_records(one)).first()
    assert text.formatted.count("<|im_end|>") == 1 and "[INST]" not in text.formatted and "</s>" not in text.formatted
    (span,) = text.loss_spans
    assert text.formatted[span.start : span.end] == "<\\/s>[\\INST] <\\|im_end|> ok [\\/INST]"


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ('{"messages":[{"role":"user","content":"a"},{"content":null,"role":"assistant"}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
        ('{"prompt":"a","response":"b"}', "prompt", [("user", "a"), ("assistant", "b")]),
        ('{"response":"b","system":"s","prompt":"a"}', "prompt", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"prompt":"a","completion":"b"}', "completion", [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"do","input":"this","output":"done"}', "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ('{"instruction":"do","input":"","output":"done"}', "instruction", [("user", "do"), ("assistant", "done")]),
        ('{"question":"q","answer":"a"}', "question", [("user", "q"), ("assistant", "a")]),
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":5},{"role":"user","content":null},{"role":"x","content":true}]}', "messages", [("user", "a"), ("assistant", "5"), ("user", ""), ("x", "true")]),
        ('{"other":1}', None, None),
        ("no json", None, None),
        (None, None, None),
    ],
)
def test_chat_layouts(spark, record, layout, turns):
    row = chat.canonical_turns(spark.createDataFrame([(record,)], "r string"), "r").first()
    assert row.layout == layout
    assert (row.turns and [tuple(t) for t in row.turns]) == turns


def brute_schedule(weights, blocks):
    """Slot by slot: of the released blocks of sources that go on, the earliest deadline; phases as sources end."""
    left, out, start = dict(blocks), [], 0
    done = dict.fromkeys(blocks, 0)
    while left := {s: n for s, n in left.items() if n}:
        total = sum(weights[s] for s in left)
        number, slot = dict.fromkeys(left, 0), 0
        while all(left[s] for s in left):
            ready = [s for s in left if number[s] * total // weights[s] <= slot]
            s = min(ready, key=lambda s: (-(-(number[s] + 1) * total // weights[s]), s))
            out.append((start + slot, s, done[s]))
            number[s] += 1
            done[s] += 1
            left[s] -= 1
            slot += 1
        start += slot
    return out


@pytest.mark.parametrize("seed", range(20))
def test_pfair_schedule(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 9) for i in range(rng.randint(1, 6))}
    blocks = {s: rng.randint(0, 40) for s in weights}
    plan = mixing.phases(weights, blocks)
    got = sorted((start + (b - first) // len(at) * length + at[(b - first) % len(at)], s, b) for s, parts in plan.items() for first, last, start, length, at in parts for b in range(first, last + 1))
    assert got == brute_schedule(weights, {s: n for s, n in blocks.items() if n})
    order = mixing.period(weights)
    for s in weights:  # less than one block from the share, at every slot
        for t in range(len(order) + 1):
            assert abs(order[:t].count(s) - t * weights[s] / len(order)) < 1


def test_mixing_rows(spark):
    rng = random.Random(1)
    rows = [(i if i % 50 else None, rng.choice(["a", "b", "c", None]), f"t{i}") for i in range(2000)] + [(5, "a", "twin"), (5, "a", "twin"), (6, "zero", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("block", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("mix_slot", F.lit("y"))
    weights = {"a": 5, "b": 3, "zero": 0}
    got = mixing.mix(docs, weights, default=2, block_rows=16, text_col="text").toPandas()
    assert sorted(got.text) == sorted(r[2] for r in rows)
    assert got.groupby("mix_slot").source.apply(lambda s: s.fillna("-").nunique()).max() == 1
    by = got.assign(source=got.source.fillna("-")).sort_values(["mix_slot", "mix_place"])
    sizes = by.groupby("source").size().to_dict()
    weight = {"a": 5, "b": 3, "c": 2, "-": 2}
    want = brute_schedule(weight, {s: -(-sizes[s] // 16) for s in weight})
    slots = by[by.source != "zero"].drop_duplicates("mix_slot")[["mix_slot", "source"]].itertuples(index=False)
    assert [tuple(x) for x in slots] == [(t, s) for t, s, _ in want]
    assert by.iloc[-1].source == "zero"
    for s in weight:  # a source's rows go by id, nulls first
        ids = by[by.source == s].doc_id.fillna(-1).tolist()
        assert ids == sorted(ids)
    assert mixing.mix(docs.limit(0), weights).count() == 0
    in_order = mixing.mixed_documents(docs.select("doc_id", "source", "text"), weights)
    assert in_order.columns == ["doc_id", "source", "text"] and in_order.count() == len(rows)


def test_mixing_equal_rows_have_their_own_places(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, 'a', 'b') as source").union(spark.sql("select 7L, 'a'"))
    rows = mixing.mix(docs, {"a": 1, "b": 1}, block_rows=16).collect()
    assert len(rows) == 2001 and len({(r.mix_slot, r.mix_place) for r in rows}) == 2001
    assert max(r.mix_place for r in rows) == 15 and sorted(r.mix_slot for r in rows)[-1] == 125


def test_schedule_of_many_sources():
    import time

    began = time.perf_counter()
    blocks = {f"s{i:04d}": 5 + i for i in range(1500)}
    plan = mixing.phases(dict.fromkeys(blocks, 1), blocks)
    assert time.perf_counter() - began < 30
    assert all(sum(last - first + 1 for first, last, *_ in plan[s]) == n for s, n in blocks.items())
    with pytest.raises(ValueError, match="slots"):
        mixing.phases({"a": 10_000_000, "b": 1}, {"a": 5, "b": 5})


PAGE = """<!DOCTYPE html><html><head><title>{t}</title><script>var a="<p>no</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=/>Home</a><li><a href=/x>{n}</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{t} &amp; more</h1><p>First<b>bold</b>  para{n}<br>line<p>Second&nbsp;one &lt;{n}&gt;<div class="advert">Buy {n}</div><form><p>Mail</p><input></form>
<section class="comments"><p>Reader {n} says no</p></section></article><aside>Side {n}</aside><footer>&copy; all</footer></body></html>"""


def test_html_article():
    pages = [PAGE.format(t=f"Title {i}", n=f"name{i}") for i in range(6)]
    want = [f"Title {i} & more\n\nFirstbold paraname{i} line\n\nSecond one <name{i}>" for i in range(6)]
    assert html_extract.extract(pages) == want
    assert html_extract.extract(pages[:1]) == want[:1]
    assert html_extract.extract([pages[0]] * 9) == want[:1] * 9  # copies show no template


def test_html_template_without_article():
    page = "<body><div><p>Our site, since ever</p></div><div><p>Text {i} tells of {i} things.</p><p>And more of {i}.</p></div><div><p>Made by us</p></div></body>"
    got = html_extract.extract([page.format(i=i * 7) for i in range(5)])
    assert got == [f"Text {i * 7} tells of {i * 7} things.\n\nAnd more of {i * 7}." for i in range(5)]


def test_html_odd_input(spark):
    broken = ["", None, "<", "<p", "plain", "</p></div>", "<p>a<div>b</p>c", "<!-- open <p>x", "<b><i>x</b>y</i>", "<p>&amp &bogus; &#65;", "<div>" * 3000 + "deep", "<p a='x>y\">z"]
    rows = [(i, f"http://h{i % 3}.example/{i}", h) for i, h in enumerate(broken)] + [(None, None, "<p>none</p>"), (3, "http://h/3", "<p>twice</p>"), (3, "http://h/3", "<p>twice</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("h", F.lit(1))
    got = html_extract.main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[0] == "" and text[4] == "plain" and text[6] == "a\n\nb\n\nc" and text[9] == "& &bogus; A" and text[10] == "deep" and text[None] == "none"
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_html_pages_table(spark):
    import html
    import re

    def plain(h):
        body = h[h.index("<article>") + 9 : h.index("</article>")]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " "))).strip() for x in re.split(r"</?(?:p|h1)>", body))
        return "\n\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == want


def brute_topk(rows, k=5):
    good = [(i, np.floor(np.array(v, dtype=float) * 256).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = set()
    for q, x in good:
        if q % 50 == 0:
            hits = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(hits, 1)}
    return out


@pytest.mark.parametrize("block_rows", [7, 100, 16_384])
def test_topk(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(300)]  # one common vector
    rows += [(None, [1.0] * 6), (2000, None), (2050, [None] * 6), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (50, rows[50][1]), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3050, [])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("x", F.lit(1))
    single = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    got = {tuple(r) for r in topk.search(data, "vec_id % 50 = 0", block_rows=block_rows).collect()}
    assert got == brute_topk(single)
    assert topk.search(data.limit(0), "vec_id % 50 = 0").count() == 0


def test_topk_stops_early():
    rng = np.random.default_rng(0)
    x = rng.integers(-100, 100, (5000, 4)).astype(np.int64)
    block, q = topk.Block(np.arange(5000), x), np.array([1000, 1, -1, 1])
    seen = []
    scored = block._scores
    block._scores = lambda rows, query: (seen.append(5000 if isinstance(rows, slice) else len(rows)), scored(rows, query))[1]
    hits = block.search(-1, q, 3)
    assert hits == [(i, s) for s, i in sorted(((int(v @ q), i) for i, v in enumerate(x)), key=lambda h: (-h[0], h[1]))[:3]]
    assert max(seen) < 5000


def test_topk_stops_by_the_bound(spark):
    """On the table of 64 dimensions and on a full block, most lists and most vectors are never read."""
    vectors = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/embeddings.parquet")
    n = vectors.count()
    rows = topk.search(vectors, "vec_id % 50 = 0", effort=True).where("rank = 1").collect()
    assert len(rows) == n // 50
    assert all(r.scored < n / 3 and r.read < n * 64 * 0.9 for r in rows)
    rng = np.random.default_rng(3)
    few = np.array([r.embedding for r in vectors.limit(2000).collect()])
    whole = np.floor(256 * (np.tile(few, (9, 1))[:16_384] + rng.normal(0, 0.02, (16_384, 64)))).astype(np.int64)
    block = topk.Block(np.arange(16_384), whole)
    for i in range(0, 16_384, 1000):
        hits = block.search(i, whole[i], 5)
        scores = whole @ whole[i]
        assert hits == [(int(j), int(scores[j])) for j in np.lexsort((np.arange(16_384), -scores)) if j != i][:5]
        assert block.scored < 16_384 / 4 and block.read < 16_384 * 64 * 0.8


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rated = docs.join(labels, "doc_id").select("doc_id", "text", quality_model.grade(F.col("quality"), F.col("toxic")).alias("grade"), (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held"))
    model = quality_model.fit(rated.where("not held"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = quality_model.rate(rated.where("held"), model).join(rated.select("doc_id", "grade"), "doc_id").toPandas()
    truth = rows.grade.iloc[:, 1] if isinstance(rows.grade, pd.DataFrame) else rows.grade
    good = truth == 2
    # 3,000 rated texts show some words of bad ones in the rarer languages too seldom to learn them
    assert rows.kept[good].mean() > 0.99 and rows.kept[~good].mean() < 0.1
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 50_000), (3, "y")], "doc_id long, text string").withColumn("score", F.lit("a"))
    assert quality_model.rate(odd, model).count() == 5
    empty = quality_model.fit(rated.limit(0), 3)
    assert quality_model.rate(odd, empty).count() == 5


def test_quality_model_is_at_its_optimum():
    """No step from the fitted parameters betters the penalised likelihood, written out plainly."""
    import math

    rng = random.Random(4)
    rows, grades = [], []
    for _ in range(240):
        g = rng.randrange(3)
        rows.append(np.array(sorted({b for b in range(6) if rng.random() < (0.7 if b % 3 == g else 0.3)}), dtype=np.int32))
        grades.append(g)
    model = quality_model.fit_sample(rows, np.array(grades), 3, least_z=1.0, rounds=3000)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.bins) >= 2

    def likelihood(weights, thresholds):
        total = -0.5 * sum(w * w for w in weights)
        for row, g in zip(rows, grades, strict=True):
            score = sum(w for b, w in zip(model.bins, weights, strict=True) if b in row)
            below = [1 / (1 + math.exp(score - t)) for t in thresholds]
            total += math.log(([*below, 1.0])[g] - ([0.0, *below])[g])
        return total

    best = likelihood(model.weights, model.thresholds)
    for i in range(len(model.bins) + 2):
        for step in (-0.05, 0.05):
            moved = np.concatenate((model.weights, model.thresholds))
            moved[i] += step
            assert likelihood(moved[: len(model.bins)], moved[len(model.bins) :]) < best + 1e-3
    score = model.score("no such words")
    assert np.allclose(model.tail(np.array([score]))[0], [1 / (1 + math.exp(t - score)) for t in model.thresholds])


def test_queries_run(spark):
    for name, query in queries.QUERIES.items():
        rows = query(spark, SMALL)
        assert len(set(rows.columns)) == len(rows.columns), name
