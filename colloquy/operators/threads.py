"""Parsing steps over raw message rows: roles and names, text filter, reply threading, numbering, chat types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that a name loses at its ends, in any script.
EDGES = r"(?U)^\s+|\s+$"


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, EDGES, ""), "[\r\n]", "")


def chat_type(session: str = "session") -> Column:
    """group if members or participants are known, private by the id's prefix, else unknown."""
    s = F.col(session)
    grouped = (F.coalesce(s["memberCount"], F.lit(0)) != 0) | (F.coalesce(F.size(s["participants"]), F.lit(0)) > 0)
    return F.when(grouped, "group").when(F.coalesce(s["wxid"], F.lit("")).startswith("wxid_"), "private").otherwise("unknown")


def typed(rows: DataFrame, group: str = "group_", private: str = "private_", chat: str = "source_file") -> DataFrame:
    """Adds chat_type from a prefix of the chat's name, for sources that don't say it themselves."""
    name = F.col(chat)
    return rows.withColumn("chat_type", F.when(name.startswith(group), "group").when(name.startswith(private), "private").otherwise("unknown"))


def display_name(chat: Column, prefixes: Sequence[str] = ("group_", "private_"), chars: int = 25) -> Column:
    """A chat's name without its type's prefix and the file's ending, cut to what a list shows."""
    out = chat
    for p in (*prefixes, ".json"):
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.substring(out, 1, chars)


def normalize_roles(rows: DataFrame, target: Column, own: Column, is_group: Column) -> DataFrame:
    """Adds sender_role and sender to rows of msg_type, is_send and sender_name.

    System messages come first, then a group's others, then the counterpart (is_send 0) and oneself (1).
    """
    given = F.nullif(F.coalesce(F.col("sender_name"), F.lit("")), F.lit(""))
    system = F.col("msg_type") == "system"
    role = F.when(system, "system").when(is_group & (F.col("is_send") == 0), "group_member").when(F.col("is_send") == 0, "target").when(F.col("is_send") == 1, "self").otherwise("unknown")
    name = F.when(system, F.coalesce(given, F.lit("system"))).when(F.col("is_send") == 0, F.coalesce(given, target)).when(F.col("is_send") == 1, F.coalesce(given, own)).otherwise(F.coalesce(given, F.lit("unknown")))
    return rows.withColumn("sender_role", role).withColumn("sender", clean_name(name))


def text_only(rows: DataFrame, kind: str = "text") -> DataFrame:
    return rows.where((F.col("msg_type") == kind) & (F.col("content") != ""))


def reply_chain(rows: DataFrame, chat: str = "source_file", position: str = "msg_id") -> DataFrame:
    """Adds reply_to: the message before it in its chat, if between group members the sender differs and else the
    role. Comes before any filter, so an answer may point to a message that is filtered later."""
    w = Window.partitionBy(chat).orderBy(position)
    before = F.lag(F.struct("msg_id", "sender", "sender_role")).over(w)
    members = (F.col("sender_role") == "group_member") & (F.col("_before.sender_role") == "group_member")
    answers = F.when(members, F.col("sender") != F.col("_before.sender")).otherwise(F.col("sender_role") != F.col("_before.sender_role"))
    return rows.withColumn("_before", before).withColumn("reply_to", F.when(F.col("_before").isNotNull() & answers, F.col("_before.msg_id"))).drop("_before")


def renumbered(rows: DataFrame, *order: str, id_col: str = "msg_id", reply_col: str = "reply_to", chat: str = "source_file") -> DataFrame:
    """Message ids from 1 in the given order over all chats, and reply_to mapped along.

    Two passes: rows are counted in each chat, a running sum over the chats gives each its offset. No window
    spans all rows. Ids were unique in a chat only, so replies are mapped within theirs.
    """
    counts = rows.groupBy(chat).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy(chat).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(chat, "_offset")
    numbered = rows.join(offsets, chat).withColumn("_new", F.row_number().over(Window.partitionBy(chat).orderBy(*order)) + F.col("_offset")).drop("_offset")
    ids = numbered.select(F.col(chat).alias("_chat"), F.col(id_col).alias("_old"), F.col("_new").alias("_reply"))
    mapped = numbered.join(ids, (F.col(chat) == F.col("_chat")) & (F.col(reply_col) == F.col("_old")), "left")
    return mapped.withColumn(id_col, F.col("_new").cast("bigint")).withColumn(reply_col, F.col("_reply").cast("bigint")).drop("_chat", "_old", "_new", "_reply")


def chat_summary(rows: DataFrame, chat: str = "source_file") -> DataFrame:
    """Messages by role for each chat, and the first name of oneself in it."""
    role = F.col("sender_role")
    return rows.groupBy(chat).agg(
        F.count("*").alias("total"),
        F.count_if(role == "target").alias("target"),
        F.count_if(role == "self").alias("self"),
        F.count_if(role == "system").alias("system"),
        F.min_by("sender", F.when(role == "self", F.col("msg_id"))).alias("self_name"),
    )
