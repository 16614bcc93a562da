"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt out into blocks of bounded size. A block sorts each dimension once. For a
query it reads the lists from the end that scores highest, those of the query's large components
deeper. What lies deeper in a list is at most the value that was read last, so each vector has a
bound: its components where a list showed it, and for the other lists their last value. Vectors
with the best bounds are scored in full, which gives a k-th score; reading goes on until few
vectors, and none that no list has shown, have a bound that reaches it. These are scored, and the
search stops: in 64 dimensions after about half of the entries and with a few per cent of the
vectors scored. Each block returns k rows a query, of which the best k are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How deep lists are read in turn, as a share of the block, for a component of the query's mean size.
DEPTHS = (1 / 64, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1, 2, 4, float("inf"))
#: A share of the block that may be left with bounds that reach the k-th score for the search to score them and stop.
FEW = 1 / 8


class Block:
    """The lists of a block's vectors, which are sorted by id. ``read`` and ``scored`` count the entries
    and vectors of the last search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.exact = self.x.astype(np.float64)
        self.lists = np.argsort(self.exact.T, axis=1, kind="stable").astype(np.int32)  # from the least value of each dimension
        self.values = np.take_along_axis(self.exact.T, self.lists, axis=1)
        self.most = float(np.abs(self.exact).max(initial=0))
        self.read = self.scored = 0

    def _scores(self, rows: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query)) < 2**52:
            return (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)  # all sums are exact
        return self.x[rows] @ query

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The positions of the k highest scores, ties to the smaller id (the lower row)."""
        if len(rows) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= kth)
        else:
            near = np.arange(len(rows))
        return near[np.lexsort((rows[near], -scores[near]))[:k]]

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """``(id, score)`` of the k best vectors but the query's own."""
        n, dims = self.x.shape
        q = query.astype(np.float64)
        size = np.abs(q)
        mean = size.mean() if size.any() else 1.0
        slack = 1e-9 * self.most * size.sum()  # sums of floats are a little off where integers are large
        own = self.ids == query_id
        known, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rows scored so far
        kth = -np.inf
        self.read, skip = 0, 0

        def score(rows: np.ndarray) -> None:
            nonlocal known, scores, kth
            rows = np.setdiff1d(rows, known)
            known, scores = np.concatenate((known, rows)), np.concatenate((scores, self._scores(rows, query)))
            if len(scores) >= k:
                kth = float(np.partition(scores, len(scores) - k)[len(scores) - k])

        for share in DEPTHS:
            depth = np.full(dims, n) if share == np.inf else np.minimum(n, np.ceil(share * n * size / mean)).astype(np.int64)
            end = [self.values[i, n - d] if q[i] > 0 else self.values[i, d - 1] if d else 0.0 for i, d in enumerate(depth.tolist())] if n else []
            unseen = float(q @ end) if n else 0.0  # no vector that the lists have not shown scores more
            skip -= 1
            if share != np.inf and (unseen + slack >= kth and len(known) >= k or skip > 0):
                continue
            bound = np.full(n, unseen)
            for i in np.flatnonzero(depth * (q != 0)):
                at = slice(n - depth[i], n) if q[i] > 0 else slice(0, depth[i])
                bound[self.lists[i, at]] += q[i] * (self.values[i, at] - end[i])
            self.read = max(self.read, int(depth[q != 0].sum()))
            bound[own] = -np.inf
            if len(bound) > 4 * k:
                score(np.setdiff1d(np.argpartition(bound, n - 4 * k)[n - 4 * k :], np.flatnonzero(own)))
            left = np.flatnonzero((bound + slack >= kth) & ~own)
            if len(left) <= FEW * n or share == np.inf:
                score(left)
                break
            skip = 2 if len(left) > n // 2 else 1
        self.scored = len(known)
        return [(int(self.ids[known[i]]), int(scores[i])) for i in self._best(known, scores, k)]


def search(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = 16_384, effort: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row for which ``is_query`` holds, the k other
    rows with the highest inner product of ``floor(scale * x)``; ties go to the smaller id.

    Rows with a null id or vector, or with a null or non-finite component, take no part. Vectors
    are compared only with vectors of their length. Rows with the same id and vector count once; a
    query never meets a row with its own id. Products must fit a long. An empty table gives an empty
    result. With ``effort`` there are two more columns, sums over the blocks: ``read``, the entries of
    lists that were read for the query, and ``scored``, the vectors scored in full.
    """
    x = F.col("x")
    asked = F.expr(f"coalesce(({is_query}), false)")
    parts = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), asked.alias("asked"))
    parts = parts.where(x.isNotNull() & F.col("id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))))
    parts = parts.select("id", "asked", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")).distinct()
    blocks = max(1, -(-vectors.count() // block_rows))
    hashed = F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int")
    stored = parts.select(hashed.alias("block"), F.lit(False).alias("asks"), "id", "x")
    queries = parts.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "x")
    dealt = stored.union(queries).withColumn("dims", F.size("x"))
    dealt = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "dims", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, block = None, [], [], None
        for b in batches:
            out: list[tuple] = []
            flat = b.column(3).flatten().to_numpy()
            at = 0
            for group, dims, asks, i in zip(*(b.column(c).to_pylist() for c in (0, 4, 1, 2)), strict=True):
                vector = flat[at : at + dims]
                at += dims
                if (group, dims) != now:
                    now, ids, rows, block = (group, dims), [], [], None
                if not asks:
                    ids.append(i)
                    rows.append(vector)
                    continue
                if block is None:
                    stacked = np.array(rows, dtype=np.int64).reshape(len(rows), dims)
                    block, ids, rows = Block(np.array(ids, dtype=np.int64), stacked), [], []
                hits = block.search(i, vector, k)
                out += [(i, *hit, group, block.read, block.scored) for hit in hits]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "block", "read", "scored"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long, block long, read long, scored long")
    if effort:
        of_block = found.groupBy("query_id", "block").agg(F.max("read").alias("read"), F.max("scored").alias("scored"))
        spent = of_block.groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("scored").alias("scored"))
    found = found.select("query_id", "vec_id", "score").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return ranked.join(spent, "query_id") if effort else ranked
