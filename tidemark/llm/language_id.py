"""Languages of a text as a mixture, by expectation-maximisation over n-gram likelihoods.

Learning counts hashed character n-grams of each language. A text's n-grams are then taken as
drawn from a mixture of the languages: EM estimates the proportions, and languages are dropped
one by one, the smallest share first, while that costs less log-likelihood than the penalty of
one more language. The prediction is the language with the largest share of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_BITS = 15
#: Odd multipliers for the characters of an n-gram.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def grams(text: str, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """How often each of the 2**BIN_BITS bins of n-grams occurs in the lower-cased text."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.zeros(1 << BIN_BITS, dtype=np.int64)
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * _MULTIPLIERS[i]
            h ^= h >> 15
        counts += np.bincount(h & ((1 << BIN_BITS) - 1), minlength=1 << BIN_BITS)
    return counts


@dataclass
class Model:
    """``shares[k, b]``: how likely an n-gram of language k falls into bin b."""

    languages: list[str]
    shares: np.ndarray

    def mixture(self, text: str, penalty: float = 4.0, rounds: int = 12) -> dict[str, float]:
        """The proportions of the languages in ``text``; empty if it has no letter or nothing was learned."""
        if not self.languages or not any(c.isalpha() for c in text):
            return {}
        counts = grams(text)
        at = np.flatnonzero(counts)
        c = counts[at].astype(np.float64)
        p = self.shares[:, at]
        n, chosen = c.sum(), list(range(len(self.languages)))

        def fit(langs: list[int], start: np.ndarray) -> tuple[np.ndarray, float]:
            if len(langs) == 1:
                return np.ones(1), float(c @ np.log(p[langs[0]]))
            q, pi, before = p[langs], start, -np.inf
            for _ in range(rounds):
                mixed = pi @ q
                now = float(c @ np.log(mixed))
                if now - before < 0.1:
                    break
                before = now
                pi = pi * (q @ (c / mixed)) / n
            return pi, before

        alone = np.log(p) @ c
        start = np.exp((alone - alone.max()) / n)
        pi, ll = fit(chosen, start / start.sum())
        while len(chosen) > 1:
            out = int(np.argmin(pi))
            fewer = chosen[:out] + chosen[out + 1 :]
            rest = np.delete(pi, out)
            new_pi, new_ll = fit(fewer, rest / rest.sum())
            if ll - new_ll > penalty * np.log(n):
                break
            chosen, pi, ll = fewer, new_pi, new_ll
        return {self.languages[k]: float(x) for k, x in zip(chosen, pi, strict=True)}


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_docs: int = 20_000, smoothing: float = 0.5) -> Model:
    """Learns from rows with a language and a text.

    Of more than ``max_docs`` such rows, a share of about that many is taken, by a hash of the id
    and the text. Their n-grams are counted in eight tasks; only eight times the bins of each
    language come to the driver.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    known = known.where("lang is not null and text is not null")
    n = known.count()
    if n > max_docs:
        known = known.where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * max_docs / n))
    schema = "lang string, bins binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + grams(text)
        rows = [x.tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(rows, pa.binary())], names=["lang", "bins"])

    sums: dict[str, np.ndarray] = {}
    for row in known.select("lang", "text").repartition(8).mapInArrow(count, schema).collect():
        sums[row.lang] = sums.get(row.lang, 0) + np.frombuffer(row.bins, dtype=np.int64)
    languages = sorted(sums)
    if not languages:
        return Model([], np.zeros((0, 1 << BIN_BITS)))
    counts = np.array([sums[k] for k in languages], dtype=np.float64) + smoothing
    return Model(languages, counts / counts.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, languages)`` of each row: the largest share's language, that
    share, and the languages chosen with their shares.

    ``und`` with score 0 if the text is null or has no letter. Equal shares: the first language in
    alphabetical order. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.mixture(t or "") for t in b.column(1).to_pylist()]
            best = [max(sorted(x), key=x.get) if x else "und" for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(best, pa.string()),
                    pa.array([min(1.0, x.get(k, 0.0)) for x, k in zip(found, best, strict=True)], pa.float64()),
                    pa.array([sorted(x.items()) for x in found], pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string, double>")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
