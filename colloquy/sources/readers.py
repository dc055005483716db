"""Readers of chat exports, message and fact files, and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.threads import chat_type, normalize_roles, reply_chain, text_only, typed

SESSION = """session STRUCT<wxid STRING, nickname STRING, displayName STRING, memberCount INT, participants ARRAY<STRING>>,
messages ARRAY<STRUCT<localId BIGINT, type STRING, content STRING, isSend INT, senderDisplayName STRING, createTime BIGINT, formattedTime STRING>>"""
MESSAGE = """msg_id BIGINT, sender STRING, sender_role STRING, content STRING, timestamp STRING, formatted_time STRING, msg_type STRING, is_send INT,
target_display STRING, reply_to BIGINT, global_msg_id BIGINT, source_file STRING"""
FACTS = """target STRING, self_name STRING, total_facts BIGINT, facts ARRAY<STRUCT<fact_id STRING, subject STRING, subject_role STRING, predicate STRING, object STRING,
source_msg_id BIGINT, source_content STRING, confidence DOUBLE, category STRING, timestamp STRING>>"""


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each JSON file of a chat export; files that can't be read are left out, as are columns of others."""
    raw = spark.read.schema(SESSION + ", _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    named = raw.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1).alias("source_file"))
    return named.where("_corrupt_record is null and messages is not null").drop("_corrupt_record")


def iso_time(seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def session_messages(spark: SparkSession, path: str, target: str | None = None, only_text: bool = True, text_type: str = "text", system_type: str = "system") -> DataFrame:
    """All messages of a folder of exports: roles and names, times (in the session's zone, UTC), the reply chain in
    the files' order, and after that the text filter."""
    files = session_files(spark, path).withColumn("chat_type", chat_type())
    m = files.select("source_file", "chat_type", F.col("session.displayName").alias("_display"), F.col("session.nickname").alias("_nick"), F.posexplode("messages").alias("position", "_m"))
    kind = F.when(F.col("_m.type") == system_type, "system").when(F.col("_m.type") == text_type, "text").otherwise(F.coalesce(F.col("_m.type"), F.lit("")))
    rows = m.select(
        "source_file",
        "chat_type",
        "position",
        F.coalesce(F.col("_m.localId"), F.lit(0)).alias("msg_id"),
        kind.alias("msg_type"),
        F.coalesce(F.col("_m.content"), F.lit("")).alias("content"),
        F.coalesce(F.col("_m.isSend"), F.lit(-1)).alias("is_send"),
        F.col("_m.senderDisplayName").alias("sender_name"),
        iso_time(F.col("_m.createTime")).alias("timestamp"),
        F.timestamp_seconds("_m.createTime").alias("ts"),
        F.coalesce(F.col("_m.formattedTime"), F.lit("")).alias("formatted_time"),
        F.coalesce(F.lit(target), F.nullif(F.col("_display"), F.lit("")), F.col("_nick"), F.lit("target")).alias("target_display"),
    )
    named = normalize_roles(rows, F.col("target_display"), F.lit("self"), F.col("chat_type") == "group").drop("sender_name")
    chained = reply_chain(named, position="position")
    return text_only(chained) if only_text else chained


def message_lines(spark: SparkSession, path: str, group: str = "group_", private: str = "private_") -> DataFrame:
    """Messages of JSON lines; blank lines are skipped. Lines don't say their chat's type, its name's prefix does."""
    return typed(spark.read.schema(MESSAGE).json(path), group, private)


def fact_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).option("multiLine", True).json(path).select("target", "self_name", F.explode("facts").alias("_f")).select("target", "self_name", "_f.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))
