"""Searches of all vectors for a stated query set, in blocks of candidates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import kept

#: Find(queries, their rows' numbers) gives a triple of arrays for the hits: positions of query and candidate, score.
Find = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Index(candidates, their rows' numbers, their ids) prepares a block once and gives its Find.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray], Find]
#: Tasks for each of the cluster's cores that a search is dealt into at least.
TASKS = 2


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) in the shared folder: numbered rows without those whose vector is null, empty or holds null or
    non-finite components, or has another length than the most vectors have."""
    v = F.col("v")
    fine = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    rows = kept(fine.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(rows: DataFrame, every: int, k: int, index: Index, score_type: str, block: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best among all
    other rows, ties to the smaller id.

    Rows are dealt evenly into blocks, whatever their ids. A task takes a block's candidates, prepares them once, and
    then streams the queries past them, returning each one's k best of the block. So a candidate moves once and only
    queries are copied, once for each block; memory is bounded by a block and an Arrow batch of queries. Only where blocks are fewer than
    the cluster's cores keep busy, queries are split into groups and a block goes to as many tasks as there are groups.
    """
    spark = rows.sparkSession
    n = rows.count()
    blocks = max(1, math.ceil(n / block))
    groups = max(1, math.ceil(TASKS * spark.sparkContext.defaultParallelism / blocks))
    place = F.xxhash64("row")
    c, g = F.pmod(place, F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int")
    every_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select(c.alias("c"), every_of(groups).alias("g"), F.lit(0).alias("asks"), "row", "id", "v")
    queries = rows.where(F.col("id") % every == 0).select(every_of(blocks).alias("c"), g.alias("g"), F.lit(1).alias("asks"), "row", "id", "v")
    names = ["query", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        find, ids, key = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block_of, group, asks, row, id_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            vectors = matrix(batch.column(5))
            change = np.nonzero((np.diff(block_of) != 0) | (np.diff(group) != 0) | (np.diff(asks) != 0))[0] + 1
            for x, y in zip([0, *change], [*change, len(row)], strict=True):
                if x == y:
                    continue
                if (block_of[x], group[x]) != key:
                    key, held, find = (block_of[x], group[x]), [], None
                part = (vectors[x:y], row[x:y], id_[x:y])
                if not asks[x]:
                    held.append(part)
                    continue
                if find is None:  # the candidates come first, so they are all here; there may be none
                    whole = [np.concatenate(p) for p in zip(*held, strict=True)] if held else [p[:0] for p in part]
                    find, ids, held = index(*whole), whole[2], []
                q, v, score = find(part[0], part[1])
                yield pa.RecordBatch.from_arrays([pa.array(part[1][q]), pa.array(part[2][q]), pa.array(ids[v]), pa.array(score)], names)

    dealt = candidates.union(queries).repartition(blocks * groups, "c", "g").sortWithinPartitions("c", "g", "asks")
    found = dealt.mapInArrow(run, f"query bigint, query_id bigint, vec_id bigint, score {score_type}")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.nonzero(score >= floor)[0]
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]
