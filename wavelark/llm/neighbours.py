"""Nearest neighbours by collision-counting hashing.

Vectors are dealt into blocks of a bounded size. A block is indexed by PROJECTIONS
random projections, each a sorted array. A query opens a window around its own
projection in every array; virtual rehashing widens all windows level by
level. A vector that lies in THRESHOLD of the windows is verified, once, by
its exact inner product. Search ends when a vector as near as the worst of the
k best found would have collided often enough with probability SURE, or when
the windows hold the block. Inner products become distances by one more
component that brings all vectors of a block to one length.
"""

from __future__ import annotations

from math import ceil, erf, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 48
THRESHOLD = 24
SURE = 0.97
GROWTH = 1.5
BLOCK_ROWS = 32_768
QUERY_ROWS = 256
FOUND = "query_id long, vec_id long, score double"


def _least_chance() -> float:
    """The collision probability at which THRESHOLD is reached with SURE."""
    choose = [lgamma(PROJECTIONS + 1) - lgamma(i + 1) - lgamma(PROJECTIONS - i + 1) for i in range(PROJECTIONS + 1)]
    lo, hi = 0.0, 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        reached = sum(np.exp(choose[i] + i * log(p) + (PROJECTIONS - i) * log(1 - p)) for i in range(THRESHOLD, PROJECTIONS + 1))
        lo, hi = (p, hi) if reached < SURE else (lo, p)
    return hi


def _width_per_distance() -> float:
    """Half a window's width, in distances, that gives that probability."""
    p, lo, hi = _least_chance(), 0.0, 20.0
    for _ in range(60):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if erf(x / sqrt(2)) < p else (lo, x)
    return hi


class Index:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        norms = (vectors**2).sum(1)
        self.most = float(norms.max())
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        rest = np.sqrt(np.maximum(self.most - norms, 0))
        at = vectors @ self.lines[:-1] + rest[:, None] * self.lines[-1]
        order = np.argsort(at, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(at, order, 0).T)
        self.order = np.ascontiguousarray(order.T)
        self.factor = _width_per_distance()

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best found, best first."""
        n = len(self.ids)
        centre = (q @ self.lines[:-1]).tolist()
        length = float((q**2).sum()) + self.most
        lo = [int(v.searchsorted(c)) for v, c in zip(self.values, centre, strict=True)]
        hi = lo.copy()
        counts = np.zeros(n, np.int64)
        open_ = self.ids != own
        width, rows, best = 0.1 * sqrt(length), np.zeros(0, np.int64), np.zeros(0)
        while True:
            fresh = []
            for j, (v, o, c) in enumerate(zip(self.values, self.order, centre, strict=True)):
                x, y = v.searchsorted((c - width, c + width)).tolist()
                x, y = min(x, lo[j]), max(y, hi[j])
                fresh += (o[x : lo[j]], o[hi[j] : y])
                lo[j], hi[j] = x, y
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.nonzero((counts >= THRESHOLD) & open_)[0]
            if len(new):
                open_[new] = False
                # quick products tell who may be among the best; theirs are exact
                scores = (self.vectors @ q)[new] if len(new) * 4 > n else self.vectors[new] @ q
                least = best[-1] if len(best) == k else np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
                new = new[scores >= least - 1e-9 * length]
                scores = (self.vectors[new] * q).sum(1)
                rows, best = np.concatenate([rows, new]), np.concatenate([best, scores])
                keep = np.lexsort((self.ids[rows], -best))[:k]
                rows, best = rows[keep], best[keep]
            whole = not any(lo) and all(y == n for y in hi)
            near = len(best) == k and width >= self.factor * sqrt(max(0.0, length - 2 * float(best[-1])))
            if whole or near or not open_.any():
                return self.ids[rows], best
            width *= GROWTH


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1).astype(np.float64)


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for every id divisible by
    `every` the k vectors of largest inner product found, best first, ties to
    the smaller id; all, where there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without an id. Rows with the query's id are its own; an
    id that repeats is one query, of its smallest vector, and as many
    candidates as it has rows. Only vectors of one length are compared.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))
    queries = rows.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    n, asked = rows.count(), queries.count()
    blocks, sets = max(1, ceil(n / block_rows)), max(1, ceil(asked / query_rows))
    numbers = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    left = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), numbers(sets).alias("set"))
    right = queries.select("id", "v", "dim", numbers(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(sets)).cast("int").alias("set"))

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if block.num_rows and asked.num_rows:
            index = Index(np.asarray(block["id"]), _matrix(block["v"]))
            for own, q in zip(np.asarray(asked["id"]).tolist(), _matrix(asked["v"]), strict=True):
                ids, scores = index.search(own, q, k)
                for column, values in zip(out, (np.full(len(ids), own), ids, scores), strict=True):
                    column.append(values)
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2].astype(float))})

    key = ["dim", "block", "set"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
