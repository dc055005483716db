"""Exact top-k by inner product with Fagin's threshold algorithm.

A block of candidates keeps, for each dimension, its rows sorted by that component. A query walks every list with a
nonzero weight from the end that scores high (the low end for a negative weight), scores each row that it meets for
the first time on all dimensions, and after each step takes the bound: the sum over the lists of weight times the
last component seen. No unseen row can score more. It stops once the kth best score is above the bound (equal is
not enough: an unseen row with a smaller id could tie). Steps double, so a query takes few of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.common import table
from colloquy.llm.vectors import Find, best, search, usable

BLOCK = 4_096
FIRST_STEP = 32
LONG = 2**63 - 1


def quantised(v: np.ndarray, scale: int = 1024) -> np.ndarray:
    return np.floor(scale * v)


def exceeds(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products may not be exact in doubles."""
    return np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) >= 2**53


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """The same as Python's integers."""
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


class Lists:
    """A block of candidates with a sorted list for each dimension. ``scored`` counts the rows that queries scored."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
        self.v, self.rows, self.ids, self.k = quantised(vectors), rows, ids, k
        self.order = np.argsort(self.v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, self.order, axis=0)
        self.scored = 0

    def __call__(self, queries: np.ndarray, q_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the positions and scores of its k best candidates, its own row left out."""
        q, v, sorted_ = quantised(queries), self.v, self.sorted
        if exceeds(q, v):
            q, v, sorted_ = (whole_numbers(x) for x in (q, v, sorted_))
        found = [self.top(weights, row, v, sorted_) for weights, row in zip(q, q_row, strict=True)]
        scores = np.concatenate([f[1] for f in found])
        if scores.dtype == object:
            scores = np.array([max(-LONG - 1, min(LONG, x)) for x in scores], np.int64)
        return np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), scores.astype(np.int64)

    def top(self, weights: np.ndarray, row: int, v: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, order = len(v), self.order
        up, down = np.nonzero(weights > 0)[0], np.nonzero(weights < 0)[0]
        seen = self.rows == row
        found, score, top = np.zeros(0, np.int64), np.zeros(0, v.dtype), np.zeros(0, np.int64)
        depth, step = 0, FIRST_STEP
        while depth < n:
            before, depth = depth, min(n, depth + step)
            step *= 2
            met = np.zeros(n, bool)
            met[order[n - depth : n - before, up]] = True
            met[order[before:depth, down]] = True
            if not len(up) and not len(down):
                met[:], depth = True, n
            new = np.nonzero(met & ~seen)[0]
            seen[new] = True
            self.scored += len(new)
            found, score = np.concatenate([found[top], new]), np.concatenate([score[top], v[new] @ weights])
            top = best(score, self.ids[found], self.k)
            bound = weights[up] @ sorted_[n - depth, up] + weights[down] @ sorted_[depth - 1, down]
            if len(top) >= self.k and score[top[-1]] > bound:
                break
        return found[top], score[top]


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(1024 x) for each query row.

    Rows with a null id, or a vector that is null, empty, of another length than most, or with null or non-finite
    components take no part. A repeated id is a candidate for its other rows, and each of its rows is a query.
    Ties go to the smaller id. Scores beyond a long are cut to its range. An empty table gives an empty result.
    """

    def index(v: np.ndarray, row: np.ndarray, ids: np.ndarray) -> Find:
        return Lists(v, row, ids, k)

    return search(usable(vectors, id_col, vector_col), every, k, index, "bigint", block)


def op3_topk_fagin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH fine AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.r <> c.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS k FROM scored)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 10
"""
