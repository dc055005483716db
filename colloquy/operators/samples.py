"""Samples and pages. Samples are ordered by a hash of the id and a seed, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(seed: int = 0, id_col: str = "msg_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sampled(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(place(seed), "msg_id").limit(n)


def stratified(rows: DataFrame, n: int, short: int = 5, medium: int = 15, seed: int = 0) -> DataFrame:
    """n // 3 rows each of short, medium and long texts."""
    size = F.length("content")
    bucketed = rows.withColumn("bucket", F.when(size <= short, "short").when(size <= medium, "medium").otherwise("long"))
    w = Window.partitionBy("bucket").orderBy(place(seed), "msg_id")
    return bucketed.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n // 3).drop("_k")


def reply_pairs(messages: DataFrame, n: int, longer_than: int = 3, seed: int = 0) -> DataFrame:
    """The counterpart's answers to oneself, both longer than a few characters."""
    t = messages.where((F.col("sender_role") == "target") & (F.length("content") > longer_than)).select(F.col("msg_id").alias("her_mid"), F.col("content").alias("her_reply"), F.col("reply_to").alias("his_mid"))
    s = messages.where((F.col("sender_role") == "self") & (F.length("content") > longer_than)).select(F.col("msg_id").alias("his_mid"), F.col("content").alias("his_msg"))
    return t.join(s, "his_mid").orderBy(place(seed, "her_mid"), "her_mid").limit(n)


def page(messages: DataFrame, limit: int, offset: int = 0, longer_than: int = 5) -> DataFrame:
    return messages.where((F.col("sender_role") == "target") & (F.length("content") > longer_than)).orderBy("msg_id").offset(offset).limit(limit)


def sample_text(messages: DataFrame, by: str, per_chunk: int = 20, chunks: int = 25) -> DataFrame:
    """Chunks of ``per_chunk`` texts each, joined by line breaks."""
    k = F.row_number().over(Window.partitionBy(by).orderBy("msg_id"))
    numbered = messages.withColumn("_k", k).where(F.col("_k") <= per_chunk * chunks)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "content"))), lambda x: x["content"]), "\n")
    return numbered.groupBy(by, F.expr(f"cast((_k - 1) div {per_chunk} as bigint)").alias("chunk")).agg(text.alias("text"))
