"""Relationships between people: replies, co-presence, strength and type, for all pairs in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ("p1", "p2")


def reply_pairs(messages: DataFrame) -> DataFrame:
    """(src person, dst person) of every answer that is there."""
    m, t = messages.where(F.col("reply_to").isNotNull()).select(F.col("sender").alias("src"), F.col("reply_to").alias("_id")), messages.select(F.col("msg_id").alias("_id"), F.col("sender").alias("dst"))
    return m.join(t, "_id").select("src", "dst")


def interaction_pairs(messages: DataFrame) -> DataFrame:
    """Unordered pairs of different people of whom one answered the other."""
    return direct_replies(messages).select(*PAIR)


def direct_replies(messages: DataFrame) -> DataFrame:
    r = reply_pairs(messages).where("src <> dst")
    return r.groupBy(F.least("src", "dst").alias("p1"), F.greatest("src", "dst").alias("p2")).agg(F.count("*").alias("direct_replies"))


def presence(messages: DataFrame) -> DataFrame:
    """Messages of each person in each chat, with the chat's type; everything on chats starts from these few rows."""
    return messages.groupBy("source_file", "chat_type", "sender").agg(F.count("*").alias("n"))


def together(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p1, p2, source_file, chat_type, n1, n2): the chats that the people of each asked pair share. The pairs lead, so
    a chat with very many members doesn't pair all of them."""
    p = presence(messages)
    a = p.select("source_file", "chat_type", F.col("sender").alias("p1"), F.col("n").alias("n1"))
    b = p.select("source_file", F.col("sender").alias("p2"), F.col("n").alias("n2"))
    return pairs.select(*PAIR).join(a, "p1").join(b, ["source_file", "p2"])


def copresence(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """For asked pairs that share a chat: shared groups, their messages in those, their messages in shared private chats.

    Counting both sides' distinct messages over the product of two people's messages is the sum of their
    counts, so chats are summed before they are joined.
    """
    a = together(messages, pairs)
    group, private = F.col("chat_type") == "group", F.col("chat_type") == "private"
    both = F.col("n1") + F.col("n2")
    return a.groupBy(*PAIR).agg(F.count_if(group).alias("shared_groups"), F.coalesce(F.sum(F.when(group, both)), F.lit(0)).alias("group_messages"), F.coalesce(F.sum(F.when(private, both)), F.lit(0)).alias("private_messages"))


def shared_groups(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p1, p2, source_file, n1, n2): the groups that the people of asked pairs share, with each one's messages."""
    return together(messages.where(F.col("chat_type") == "group"), pairs).select(*PAIR, "source_file", "n1", "n2")


def strength(direct: Column, group_messages: Column) -> Column:
    return F.round(15 * F.log1p(direct) + 5 * F.log1p(group_messages), 1)


def kind(direct: Column, groups: Column, private: Column) -> Column:
    return F.when(direct >= 50, "close_private").when(groups >= 3, "group_regular").when(groups >= 1, "group_acquaintance").when(private > 0, "light_private").otherwise("none")


def relationships(messages: DataFrame) -> DataFrame:
    """All pairs with an answer: counts, strength, type."""
    d = direct_replies(messages)
    joined = d.join(copresence(messages, d), list(PAIR), "left")
    for c in ("shared_groups", "group_messages", "private_messages"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    return joined.withColumn("interaction_strength", strength(F.col("direct_replies"), F.col("group_messages"))).withColumn("relationship_type", kind(F.col("direct_replies"), F.col("shared_groups"), F.col("private_messages")))


def contact_extras(messages: DataFrame) -> DataFrame:
    """(p1, p2, mean_lag_seconds, late_night_ratio) of answers: beyond what the pairs' strength uses."""
    m = messages.where(F.col("reply_to").isNotNull()).select(F.col("sender").alias("src"), F.col("ts").alias("t2"), F.col("reply_to").alias("_id"))
    t = messages.select(F.col("msg_id").alias("_id"), F.col("sender").alias("dst"), F.col("ts").alias("t1"))
    r = m.join(t, "_id").where("src <> dst")
    lag = F.unix_timestamp("t2") - F.unix_timestamp("t1")
    return r.groupBy(F.least("src", "dst").alias("p1"), F.greatest("src", "dst").alias("p2")).agg(F.round(F.avg(lag), 3).alias("mean_lag_seconds"), F.round(F.avg((F.hour("t2") < 6).cast("double")), 4).alias("late_night_ratio"))
