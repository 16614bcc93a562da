"""A quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are ordered grades 0..K-1. A text's score is a sum of shared weights of its hashed tokens;
ordered thresholds cut the score: P(grade <= j) = sigmoid(threshold_j - score). This gives
an expected grade and the probability of the top grades, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1 << 18
_TOKEN = regex.compile(r"\p{L}+|[^\s\p{L}\p{N}]+")
_SHOUT, _PAIR, _NOISE = (crc32(b"trait " + x) % BINS for x in (b"shout", b"pair", b"noise"))


def features(text: str) -> np.ndarray:
    """The sorted bins of a text's tokens: lower-cased words, runs of other signs, and three traits:
    many words in capitals, many words said again at once, and many signs other than punctuation."""
    tokens = _TOKEN.findall(text)
    words = [t for t in tokens if t[0].isalpha()]
    bins = {crc32(t.encode("utf-8", "surrogatepass")) % BINS for t in set(map(str.lower, tokens))}
    if len(words) >= 4:
        if sum(w.isupper() for w in words) * 2 > len(words):
            bins.add(_SHOUT)
        if sum(a == b for a, b in zip(words, words[1:], strict=False)) * 5 > len(words):
            bins.add(_PAIR)
        if sum(not t[0].isalpha() and t[-1] not in ".,;:'-)" for t in tokens) * 4 > len(words):
            bins.add(_NOISE)
    return np.array(sorted(bins), dtype=np.int32)


@dataclass
class Model:
    """Weights by bin (few are not 0) and ordered thresholds."""

    bins: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def score(self, text: str) -> float:
        own = features(text)
        at = np.minimum(np.searchsorted(self.bins, own), max(0, len(self.bins) - 1))
        return float(self.weights[at[self.bins[at] == own]].sum()) if len(self.bins) else 0.0


def fit_sample(rows: list[np.ndarray], grades: np.ndarray, grades_n: int, l2: float = 1.0, least_z: float = 5.0, rounds: int = 300) -> Model:
    """Fits bins that tell grades apart, by gradient steps on the likelihood with an L2 penalty.

    A bin takes part if its share among the texts of some grade below the top lies ``least_z``
    standard errors or more over its share among all: common words of long texts are then no
    evidence for a good grade that would outweigh signs of a bad one.
    """
    n = np.maximum(np.bincount(grades, minlength=grades_n), 1).astype(float)
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    of = np.repeat(grades.astype(np.int8), lengths)
    seen = np.array([np.bincount(flat[of == g], minlength=BINS) for g in range(grades_n)], dtype=float)
    p = (seen.sum(axis=0) + 0.5) / (n.sum() + 1)
    z = (seen - n[:, None] * p) / np.sqrt(n[:, None] * p * (1 - p) + 0.5)
    bins = np.flatnonzero(z[:-1].max(axis=0) >= least_z).astype(np.int32)
    # a sparse matrix of the bins that take part, by (row, column) pairs
    place = np.full(BINS, -1, dtype=np.int32)
    place[bins] = np.arange(len(bins))
    column = place[flat]
    has = column >= 0
    where, column = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)[has], column[has]
    del flat, of, has, seen
    below = np.clip(np.cumsum(n)[:-1] / n.sum(), 1e-3, 1 - 1e-3)
    first, gaps = np.log(below[0] / (1 - below[0])), np.log(np.maximum(np.diff(np.log(below / (1 - below))), 1e-2))
    w = np.zeros(len(bins))
    params = np.concatenate(([first], gaps, w))
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    k = grades_n - 1
    for t in range(1, rounds + 1):
        first, gaps, w = params[0], params[1:k], params[k:]
        th = np.concatenate(([first], first + np.cumsum(np.exp(gaps))))
        s = np.bincount(where, w[column], minlength=len(rows))
        cdf = 1 / (1 + np.exp(np.clip(s[:, None] - th[None, :], -40, 40)))
        cdf = np.hstack([np.zeros((len(rows), 1)), cdf, np.ones((len(rows), 1))])
        own = np.arange(len(rows))
        hi, lo = cdf[own, grades + 1], cdf[own, grades]
        prob = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g_th = np.zeros(k)
        np.add.at(g_th, np.minimum(grades, k - 1), np.where(grades < k, d_hi, 0))
        np.add.at(g_th, np.maximum(grades - 1, 0), np.where(grades > 0, -d_lo, 0))
        g_s = -(d_hi - d_lo)
        g_w = np.bincount(column, g_s[where], minlength=len(bins)) - l2 * w
        tail = np.cumsum(g_th[::-1])[::-1]
        g = np.concatenate(([tail[0]], tail[1:] * np.exp(gaps), g_w)) / max(1, len(rows))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        params = params + 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    first, gaps, w = params[0], params[1:k], params[k:]
    return Model(bins, w, np.concatenate(([first], first + np.cumsum(np.exp(gaps)))))


def sampled(grades: DataFrame, max_docs: int = 20_000) -> DataFrame:
    """Of more than ``max_docs`` rows with a grade, about that many, by a hash of the row, and never
    over twice as many: a table of bounded size, to be joined to texts by broadcasting it."""
    known = grades.where(F.col("grade").isNotNull())
    n = known.count()
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64(*known.columns), F.lit(1_000_003)) < int(1_000_003 * max_docs / n))
    return known.limit(2 * max_docs)


def fit(rated: DataFrame, grades_n: int, text_col: str = "text", grade_col: str = "grade", max_docs: int = 20_000, **options) -> Model:
    """Fits on rows with a grade and a text. Of more than ``max_docs`` such rows, a share of about
    that many is taken by a hash of the text; only their bins come to the driver."""
    known = rated.select(F.col(text_col).cast("string").alias("text"), F.col(grade_col).cast("int").alias("grade"))
    known = known.where(F.col("text").isNotNull() & F.col("grade").between(0, grades_n - 1)).withColumn("h", F.xxhash64("text"))
    n = known.count()
    if n > max_docs:
        known = known.where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * max_docs / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [features(t).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), b.column(1)], names=["bins", "grade"])

    got = known.select("text", "grade").mapInArrow(run, "bins binary, grade int").collect()
    got.sort(key=lambda r: (r.grade, bytes(r.bins)))
    return fit_sample([np.frombuffer(r.bins, dtype=np.int32) for r in got], np.array([r.grade for r in got], dtype=np.int64), grades_n, **options)


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating of the labels: 0 toxic, 1 poor, 2 good; null without a label."""
    return F.when(toxic == 1, 0).when((quality == 0) & toxic.isNotNull(), 1).when((quality == 1) & toxic.isNotNull(), 2)


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """``(doc_id, score, expected_grade, tail_probability, grade, kept)`` of each row.

    ``tail_probability`` is that of the top grade; ``kept`` holds from ``keep_from`` on. A null or
    empty text has score 0. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([model.score(t or "") for t in b.column(1).to_pylist()], dtype=float)
            tail = model.tail(score)
            cdf = np.hstack([np.ones((len(score), 1)), tail, np.zeros((len(score), 1))])
            likely = np.argmax(cdf[:, :-1] - cdf[:, 1:], axis=1) if len(score) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1]), pa.array(likely.astype(np.int32)), pa.array(tail[:, -1] >= keep_from)],
                names=["doc_id", "score", "expected_grade", "tail_probability", "grade", "kept"],
            )

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, expected_grade double, tail_probability double, grade int, kept boolean")
