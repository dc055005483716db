"""A corpus pipeline: documents in, token ids out. Each stage is written as Parquet and read again by the next.

All stages take null, empty and very long texts, null and repeated ids, empty tables, and further columns of any name,
which all but the last give back."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import ready, table
from colloquy.llm.line_templates import dedup_lines
from colloquy.llm.mixing import WEIGHTS, mix
from colloquy.llm.near_copies import first_of_each
from colloquy.llm.quality import accepted, bad_labels
from colloquy.llm.sentencepiece_fst import model_bytes, pieces_of
from colloquy.shipping import ship

#: Part of the kept tokens that the mix takes; no document is taken twice.
MIX_SHARE = 0.8
#: Words that a worker of the last stage remembers; the executors' memory is well used by then.
WORDS = 250_000
#: A document that is so much like one earlier document, by its lines, is a copy, which the near dedup after the line dedup takes.
COPIES = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for low quality or toxic. Each row is judged by itself; null and
    empty texts are judged as empty ones, null sources and languages are sites of their own."""
    ship(spark)
    return accepted(docs, bad_labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template an earlier document holds; n_chars follows the text. Near copies of
    a whole document lose what that one loses, and are left to the next stage, which would not know them by what little
    doesn't recur. Null texts stay null; rows that repeat id and text are one document and are cleaned alike."""
    ship(spark)
    return dedup_lines(docs, copies=COPIES).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: similarity 0.8 or more on five-word shingles. Null and empty texts are
    one class; rows that repeat id and text leave one row."""
    ship(spark)
    return first_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take. Null sources and languages count as empty names; null and empty texts weigh
    nothing and go with the prefix that they stand in."""
    ship(spark)
    weights = spark.createDataFrame(list(WEIGHTS), "domain string, lang string, source string, weight double")
    return mix(docs, weights, share=MIX_SHARE, epochs=1).select("row.*")


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, checked by decoding them; none for null and empty texts."""
    ship(spark)
    return pieces_of(docs, model_bytes(), memory=WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Fingerprints, the fitted classifier and the tokenizer can't be written in SQL; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4()}"
    docs = table(spark, sf_dir, "documents")
    read = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:  # what the stage was read from is needed no more
            remove(spark, read)
        read = f"{folder}/{name}"
    return docs
