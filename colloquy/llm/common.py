"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table whose row width is known is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def ready(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the session's ``spark.checkpoint.dir``, one of our own only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = context.master.startswith("local[") or context.master == "local"
        folder = tempfile.mkdtemp(prefix="checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    context.setCheckpointDir(folder)


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of at most ``rows`` rows unless the session has its own number: whole texts may be long. Their bytes
    are bounded by the session's maxBytesPerBatch (64 MB unless set), so a batch of huge texts has fewer rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, rows)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within ``limit``; otherwise as it is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def partitions(spark: SparkSession, rows: int = 0, per_task: int = 1_000_000) -> int:
    """Shuffle partitions for ``rows`` rows: the session's setting, more where a task would get over ``per_task``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def named(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that other columns of the input can't clash with ours."""
    return df.select(*(F.col(f"`{c}`") for c in wanted))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
