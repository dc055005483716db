"""Approximate nearest neighbours by collision counting.

The measure is the inner product, so vectors are first put where the nearest is the largest product: each is
divided by the longest vector's length and given one more component that brings it to length one; a query is
brought to length one. Then |q - x|^2 = 2 - 2 q.x / (|q| longest).

Each of ``m`` projections keeps a block's vectors sorted by their projection. The projections are random rotations, so
that those of one rotation don't repeat each other. Around a query's projection
a window of half width ``width * R`` is open; a vector inside collides with the query in that projection. Virtual
rehashing makes R grow by ``growth``, and only what the windows newly cover is counted (of the first windows, what they
leave out, if that is less). A vector that collides in
at least ``share`` of the projections is verified once, on the original vectors. The search ends when k verified
vectors lie within R, or the windows cover all. A vector at distance R collides in a projection with probability
2 Phi(width) - 1 = 0.87, one at the distance of a random vector (1.4) and R = 1 with 0.71, so the threshold of 0.84 keeps
most of the near ones and few of the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table
from colloquy.llm.vectors import Find, best, search, usable

BLOCK = 16_384
M, WIDTH, SHARE, FIRST, GROWTH, SEED = 64, 1.5, 0.84, 0.85, 1.05, 42


def on_sphere(v: np.ndarray, longest: float) -> np.ndarray:
    v = v / longest
    rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", v, v)))
    return np.concatenate([v, rest[:, None]], axis=1)


def projections(d: int, m: int) -> np.ndarray:
    """(d, m): columns of random rotations, scaled so that a unit vector's projections have variance one."""
    r = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(r.standard_normal((d, d)))[0] for _ in range(-(-m // d))], axis=1)[:, :m] * np.sqrt(d)


class Collisions:
    """A block of vectors, indexed. ``verified`` counts the vectors that searches looked at, ``searched`` the queries."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, longest: float, m: int = M, width: float = WIDTH, share: float = SHARE):
        self.vectors, self.rows, self.ids, self.k, self.longest, self.m, self.width = vectors, rows, ids, k, longest, m, width
        self.needed = max(1, int(np.ceil(share * m)))
        self.lines = projections(vectors.shape[1] + 1, m)
        projected = on_sphere(vectors, longest) @ self.lines
        order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.lists = np.ascontiguousarray(np.take_along_axis(projected.T, order, axis=1))
        self.order = order.ravel()
        self.verified = self.searched = 0

    def __call__(self, queries: np.ndarray, q_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the positions and scores of the k nearest found, its own row left out."""
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        centre = (queries / lengths[:, None]) @ self.lines[: queries.shape[1]]
        reach = 2 * max(np.abs(self.lists).max(initial=0), np.abs(centre).max(initial=0)) + 1
        shift = np.arange(self.m) * 2 * reach  # the lists end to end, so that one search finds all windows' ends
        flat = (self.lists + shift[:, None]).ravel()
        found = [self.nearest(q, r, length, c + shift, flat, reach) for q, r, length, c in zip(queries, q_row, lengths, centre, strict=True)]
        self.searched += len(queries)
        return np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def counted(self, *spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How often each vector stands in the lists' spans."""
        parts = [self.order[x:y] for starts, ends in spans for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.bincount(np.concatenate(parts), minlength=len(self.vectors))

    def nearest(self, query: np.ndarray, row: int, length: float, centre: np.ndarray, flat: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.vectors)
        base = np.arange(self.m) * n
        hits, done = np.zeros(n, np.int64), self.rows == row
        found, score, top = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        lo = hi = None
        radius = FIRST
        while True:
            half = min(self.width * radius, reach)
            left = np.searchsorted(flat, centre - half, side="left").clip(base, base + n)
            right = np.searchsorted(flat, centre + half, side="right").clip(base, base + n)
            if lo is None and 2 * (right - left).sum() > self.m * n:
                hits += self.m - self.counted((base, left), (right, base + n))
            else:
                hits += self.counted((left, right)) if lo is None else self.counted((left, lo), (hi, right))
            lo, hi = left, right
            new = np.nonzero((hits >= self.needed) & ~done)[0]
            if len(new):
                done[new] = True
                self.verified += len(new)
                found, score = np.concatenate([found[top], new]), np.concatenate([score[top], (self.vectors[new] * query).sum(axis=1)])
                top = best(score, self.ids[found], self.k)
            all_covered = (left == base).all() and (right == base + n).all()
            if all_covered or len(top) >= self.k and 2 - 2 * score[top[-1]] / (length * self.longest) <= radius * radius:
                return found[top], score[top]
            radius *= GROWTH


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k found with the largest inner products.

    Rows with a null id, or a vector that is null, zero, of another length than most, or with null or non-finite
    components take no part. Each row of a repeated id is a query and a candidate for the others. Ties go to the
    smaller id. Every row is indexed; the projections come from a seed, and only the longest vector's length is
    taken from the data. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    longest = rows.agg(F.max(length)).first()[0] or 1.0

    def index(vectors: np.ndarray, row: np.ndarray, ids: np.ndarray) -> Find:
        return Collisions(vectors, row, ids, k, longest)

    return search(rows, every, k, index, "double", block)


def op5_ann_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
