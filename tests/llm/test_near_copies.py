"""The pipeline's near-duplicates against brute force over all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from conftest import SMALL
from tidemark.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(texts):
    """``texts``: id -> text; the ids that stay."""

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in texts if find(i) == i}


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def planted():
    """Edited copies, single and in a large group, beside texts that share a long passage."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    texts = [prose(rng.randint(20, 300)) for _ in range(150)]
    texts += [edited(t, rng.randint(1, 6)) for t in texts[:100]]
    passage, base = prose(60), prose(150)
    texts += [prose(rng.randint(5, 80)) + passage for _ in range(60)]
    texts += [edited(base, rng.randint(0, 5)) for _ in range(120)]
    texts += [prose(n) for n in range(8)] * 2
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_planted_near_copies(spark):
    texts = planted()
    want = brute_kept(texts)
    assert len(want) < len(texts) - 150
    assert kept(spark, texts) == want


def test_documents(spark):
    rows = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    assert kept(spark, texts) == brute_kept(texts)


def test_bitmaps_rule_no_similar_pair_out():
    """Bits that differ are never more than shingles that do, folded or not."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 100, 500):
        whole = rng.integers(-(2**63), 2**63 - 1, n)
        for other in (whole[: max(1, n * 4 // 5)], np.concatenate((whole[n // 10 :], rng.integers(0, 2**62, n // 10)))):
            a, b = (near_copies.parity(np.unique(s)) for s in (whole, other))
            words = min(len(a), len(b))
            a, b = (p if len(p) == words else p[:words] ^ p[words:] for p in (a, b))
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(whole, other))
    assert near_copies.parity(np.empty(0, dtype=np.int64)).tolist() == [0]


def cloud(n):
    """Copies of one text with up to 5 words replaced; those with four or more are far from most others."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((0, 1, 2, 3, 4, 5, 5))):
            words[at] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    return texts


def test_candidates_of_one_large_group_are_few(spark, monkeypatch):
    """The last step pairs what neighbours left apart: without places and distances most far copies with most of the group."""
    seen = []
    possible = near_copies._possible
    monkeypatch.setattr(near_copies, "_possible", lambda pairs, nodes: seen.append(pairs.count()) or possible(pairs, nodes))
    texts = cloud(900)
    assert kept(spark, texts) == brute_kept(texts)
    assert seen[-1] <= 2 * len(texts), seen
