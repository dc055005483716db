"""Node and edge tables of the conversation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("target", "self", "group_member", "system")


def persons(messages: DataFrame) -> DataFrame:
    """One row for each name; of several roles the first of ROLES holds."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("sender_role")), F.lit(0)).cast("int")
    best = F.min(F.when(rank > 0, rank)).alias("rank")
    known = messages.where(F.coalesce(F.col("sender"), F.lit("")) != "").groupBy(F.col("sender").alias("name")).agg(best)
    return known.select("name", F.coalesce(F.get(F.array(*map(F.lit, ROLES)), F.col("rank") - 1), F.lit("unknown")).alias("role"))


def said_edges(messages: DataFrame, people: DataFrame) -> DataFrame:
    return messages.where(F.col("sender_role").isin(*ROLES)).join(people.select("name"), F.col("sender") == F.col("name")).select("name", "msg_id")


def reply_edges(messages: DataFrame) -> DataFrame:
    """(src, dst) of answers whose other message is there; the rest is dropped."""
    ids = messages.select(F.col("msg_id").alias("dst"))
    return messages.where(F.col("reply_to").isNotNull()).select(F.col("msg_id").alias("src"), F.col("reply_to").alias("dst")).join(ids, "dst", "left_semi").select("src", "dst")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that break uniqueness; empty where the constraint holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_row")).select(*keys, "_row.*")


#: Names up to which each text is searched for every name.
LITERALS = 500


def containing(messages: DataFrame, names: DataFrame, name: str, text: str = "content") -> DataFrame:
    """Rows (messages' columns, name) for each name that is a substring of the text.

    A short list of names goes into the plan and each text is searched for it, without a join. With a longer list
    each text is cut into its substrings that start like a name and are as long as one, and these meet
    the names in an equi-join: no comparison of every name with every message.
    """
    sized = names.select(F.col(name)).where(F.length(name) > 0).distinct()
    short = [r[0] for r in sized.limit(LITERALS + 1).collect()]
    if len(short) <= LITERALS:
        held = F.filter(F.array(*map(F.lit, sorted(short))).cast("array<string>"), lambda x: F.contains(F.col(text), x))
        return messages.withColumn(name, F.explode(held))
    return containing_join(messages, sized, name, text)


def containing_join(messages: DataFrame, sized: DataFrame, name: str, text: str = "content", id_col: str = "msg_id") -> DataFrame:
    """The join of ``containing``: only ids and substrings meet the names; the rows come back by their ids."""
    lengths = sorted(r[0] for r in sized.select(F.length(name)).distinct().collect())  # at most the longest name's
    ids = messages.select(id_col, text)
    cuts = F.transform(F.array(*map(F.lit, lengths)), lambda k: F.when(k <= F.length(text), F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(F.col(text), i, k))).otherwise(F.array().cast("array<string>")))
    found = ids.select(id_col, F.explode(F.array_distinct(F.flatten(cuts))).alias(name)).join(sized, name, "left_semi")
    return messages.join(found.distinct(), id_col)


def mentions(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """(msg_id, entity): entities of two characters or more that a message names; each pair once."""
    usable = entities.where(F.length("entity") >= 2)
    return containing(messages.select("msg_id", "content"), usable, "entity").select("msg_id", "entity").distinct()


def about(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """(msg_id, topic): a keyword of the topic is in the message; topics has (topic, keyword)."""
    words = containing(messages.select("msg_id", "content"), topics.select("keyword"), "keyword")
    return words.join(topics.select("topic", "keyword").distinct(), "keyword").select("msg_id", "topic").distinct()


def cooccurrence(pairs: DataFrame, key: str, item: str, least: int = 2, extra: Column | None = None) -> DataFrame:
    """(p1 < p2, weight): items that share at least ``least`` keys; each item counts once for a key."""
    once = pairs.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    a, b = once.select(F.col(key), F.col(item).alias("p1")), once.select(F.col(key), F.col(item).alias("p2"))
    return a.join(b, key).where("p1 < p2").groupBy("p1", "p2").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
