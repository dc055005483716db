"""Connected components by alternating star contractions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder (``spark.checkpoint.dir``; our own only where none is set)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            local = context.master.startswith("local[") or context.master == "local"
            folder = tempfile.mkdtemp(prefix="checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def met(edges: DataFrame, low: DataFrame) -> DataFrame:
    hashed = F.xxhash64("u").alias("h")
    return edges.select("*", hashed).join(low.select("*", hashed), ["u", "h"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` that isn't its own root; root is the component's smallest node.

    Each round links every node's smaller neighbours to its smallest one (small star), then its larger ones
    (large star), which sees each edge from both ends and so comes after what thins them out. Joins are dealt by a
    node and its hash, not by the node alone as the minima are: so they are shuffles of their own, which adaptive execution can split. A round shuffles rows by node only, in aggregations that combine on the map side and joins that
    can be split, so a node with very many neighbours doesn't gather in one task. Rounds grow as the
    logarithm of the longest chain. Null ends and self-loops are left out; an empty table gives no rows.
    """
    now = durable(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    )
    before = signature(now)
    for _ in range(rounds):
        if not before[0]:
            break
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        small = met(now, low).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        few = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        both = few.union(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = durable(met(both, low).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        after = signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
