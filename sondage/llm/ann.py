"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into a grid of blocks. A tile multiplies the vectors rounded to int8 and bounds the error
by the norms of what rounding took away (Cauchy-Schwarz): only pairs whose upper bound reaches the k-th lower bound of
their query are computed again in double precision. Each block keeps k rows per query, and heaps merge the blocks, so the
result is exact and no block of scores is ever shuffled.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, in which their products are exact), scale, norm of the error, norm of what is kept."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.float32 if x.shape[1] <= 1024 else np.float64), scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so equal vectors get equal scores."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best per query: larger score, then smaller id."""
    by = np.lexsort((vec, -score, query))
    q = query[by]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return by[place < k]


def block_nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, tile: tuple[int, int] = (512, 4096)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k nearest candidates of each query within one block."""
    out = []
    c8, cs, cerr, _ = quantise(c)
    cnorm = np.linalg.norm(c, axis=1)
    for a in range(0, len(q), tile[0]):
        own, ids = q[a : a + tile[0]], qid[a : a + tile[0]]
        q8, qs, qerr, qkept = quantise(own)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        floor = np.full(len(own), -np.inf)
        for b in range(0, len(c), tile[1]):
            to = slice(b, b + tile[1])
            near = (q8 @ c8[to].T).astype(np.float64) * (qs[:, None] * cs[None, to])
            room = (qerr[:, None] * cnorm[None, to] + qkept[:, None] * cerr[None, to]) * (1 + 1e-9) + 1e-12 * (1 + np.abs(near))
            low, high = near - room, near + room
            self_ = ids[:, None] == cid[None, to]
            low[self_], high[self_] = -np.inf, -np.inf
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
            i, j = np.nonzero((high >= floor[:, None]) & ~self_)
            score = exact(own[i], c[to][j])
            pool = tuple(np.concatenate(x) for x in zip(held, (i, cid[to][j], score), strict=True))
            keep = best(*pool, k)
            held = tuple(x[keep] for x in pool)
            counts = np.bincount(held[0], minlength=len(own))
            lowest = np.full(len(own), np.inf)
            np.minimum.at(lowest, held[0], held[2])
            floor = np.maximum(floor, np.where(counts >= k, lowest, -np.inf))
        out.append((ids[held[0]], held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; of rows that repeat an id the first in component order."""
    ids = t.column("id").to_numpy()
    x = t.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), dim)
    if len(np.unique(ids)) < len(ids):
        by = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[by], x[by]
        first = np.r_[True, ids[1:] != ids[:-1]]
        ids, x = ids[first], x[first]
    return ids, x


def nearest(queries: DataFrame, candidates: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = 2048, candidate_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest candidates by inner product.

    Nearest first, ties to the smaller id; a candidate with the query's own id is left out. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do null ids; vectors of different length never meet; of
    rows that repeat an id one counts; fewer than k candidates come all; empty tables give no rows.

    Blocks are replicated along the other side of the grid only: query_rows * candidate_rows bounds a task's work, and the
    hash of the id deals the rows, so equal vectors do not pile up.
    """
    own = lambda df: df.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.size(vector_col).alias("dim"))
    q, c = own(queries), own(candidates)
    g, h = (max(1, -(-df.count() // n)) for df, n in ((q, query_rows), (c, candidate_rows)))
    q = q.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    c = c.withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(h)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) and len(right):
            dim = left.column("dim")[0].as_py()
            found = block_nearest(*_matrix(left, dim), *_matrix(right, dim), k)
        else:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    key = ["dim", "i", "j"]
    blocks = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(tile, "query_id long, vec_id long, score double")

    def merge(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, score in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        rows = [(query, rank, -vec, score) for query, heap in heaps.items() for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1)]
        if rows:
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return blocks.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
