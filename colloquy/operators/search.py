"""Keyword and graph search over messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.functions import rules
from colloquy.operators.edges import containing


def topic_hits(topics: DataFrame, asked: str) -> DataFrame:
    """(topic, hits): the topic's words that the question holds."""
    return topics.where(F.lit(asked).contains(F.col("word"))).groupBy("topic").agg(F.count_distinct("word").alias("hits"))


def expand(topics: DataFrame, asked: str) -> DataFrame:
    """(word, layer, hit): layer 1 are the words of the topic with most hits, layer 2 the other hit topics' words;
    the question itself if nothing is hit. Topics are few: they are a lexicon."""
    hits = topic_hits(topics, asked)
    first = hits.orderBy(F.desc("hits"), "topic").limit(1).first()
    if first is None:
        return topics.sparkSession.createDataFrame([(asked, 1)], "word string, layer int")
    layer = F.when(F.col("topic") == first["topic"], 1).otherwise(2)
    return topics.join(hits.select("topic"), "topic", "left_semi").groupBy("word").agg(F.min(layer).alias("layer"))


def layered(messages: DataFrame, topics: DataFrame, asked: str, about: DataFrame, mentions: DataFrame, limit: int | None = 15, enough: int = 5) -> DataFrame:
    """Messages with the first layer that finds them: words of layer 1; those of layer 2 if layer 1 finds fewer than
    ``enough``; messages about a hit topic; messages that name one of the words. The latest ones first."""
    words = expand(topics, asked)
    held = containing(messages.select("msg_id", "content"), words.select("word"), "word").select("msg_id", "word").join(words, "word").select("msg_id", "layer").distinct()
    few = held.where("layer = 1").select("msg_id").distinct().limit(enough).agg((F.count("*") < enough).alias("_few"))
    by_word = held.where((F.col("layer") == 1) | few.scalar()).select("msg_id", "layer")
    by_topic = about.join(topic_hits(topics, asked), "topic", "left_semi").select("msg_id", F.lit(3).alias("layer"))
    by_name = mentions.join(words.select(F.col("word").alias("entity")), "entity", "left_semi").select("msg_id", F.lit(4).alias("layer"))
    first = by_word.unionByName(by_topic).unionByName(by_name).groupBy("msg_id").agg(F.min("layer").alias("layer"))
    found = first.join(messages, "msg_id").orderBy(F.desc("msg_id"))
    return found.limit(limit) if limit else found


def banded(left: DataFrame, right: DataFrame, width: int, left_id: str, right_id: str) -> DataFrame:
    """Pairs whose ids differ by less than ``width`` and are not equal: rows are put in bands of that width and each
    left row meets its own band and the two beside it, so the join is an equi-join."""
    band = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("_band", F.explode(F.array(*(band(left_id) + k for k in (-1, 0, 1)))))
    b = right.withColumn("_band", band(right_id))
    near = (F.abs(F.col(left_id) - F.col(right_id)) < width) & (F.col(left_id) != F.col(right_id))
    return a.join(b, "_band").where(near).drop("_band")


def path_pairs(messages: DataFrame, start: Column, end: Column, width: int = 5, limit: int | None = 15) -> DataFrame:
    """Messages near each other of which one meets ``start`` and the other ``end``."""
    a = messages.where(start).select(F.col("msg_id").alias("from_id"))
    b = messages.where(end).select(F.col("msg_id").alias("to_id"))
    found = banded(a, b, width, "from_id", "to_id").orderBy(F.desc("from_id"), F.desc("to_id"))
    return found.limit(limit) if limit else found


def conversation_pairs(messages: DataFrame, word: str, width: int = 10, limit: int | None = 5) -> DataFrame:
    """One's own and the counterpart's messages near each other that both hold a word."""
    held = messages.where(F.col("content").contains(word))
    a = held.where(F.col("sender_role") == "self").select(F.col("msg_id").alias("self_id"), F.col("content").alias("self_text"))
    b = held.where(F.col("sender_role") == "target").select(F.col("msg_id").alias("target_id"), F.col("content").alias("target_text"))
    found = banded(a, b, width, "self_id", "target_id").orderBy(F.desc("self_id"), F.desc("target_id"))
    return found.limit(limit) if limit else found


def topic_months(messages: DataFrame, words: Sequence[str], sad: Column) -> DataFrame:
    """Messages on a topic by month, and the sad ones among them."""
    return messages.where(rules.any_of(F.col("content"), words)).groupBy("month").agg(F.count("*").alias("cnt"), F.count_if(sad).alias("sad"))


def mentions_by_speaker(messages: DataFrame, word: str, keep: int = 3) -> DataFrame:
    """How often each speaker uses a word, with the first texts."""
    held = messages.where(F.col("content").contains(word))
    counts = held.groupBy("sender").agg(F.count("*").alias("n"))
    first = held.withColumn("_k", F.row_number().over(Window.partitionBy("sender").orderBy("msg_id"))).where(F.col("_k") <= keep)
    texts = F.sort_array(F.collect_list(F.struct("_k", F.substring("content", 1, 50).alias("t"))))
    samples = first.groupBy("sender").agg(F.transform(texts, lambda x: x["t"]).alias("samples"))
    return counts.join(samples, "sender")


def entity_link(entities: DataFrame, asked: str, most: int = 5) -> DataFrame:
    """Entities that a question names by name or alias, the longest names first; entities has (type, name, aliases)."""
    q = F.lit(asked)
    held = q.contains(F.col("name")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (F.length(a) > 0) & q.contains(a))
    w = Window.partitionBy("type").orderBy(F.desc(F.length("name")), "name")
    return entities.where(held).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def related(mentions: DataFrame, about: DataFrame, entity, top: int = 20) -> DataFrame:
    """Topics and other entities of the messages that name an entity, by number of messages; entities may be null."""
    own = mentions.where(F.col("entity") == entity).select("msg_id").distinct()
    others = mentions.where(F.col("entity") != entity).select("msg_id", F.col("entity").alias("other"))
    found = own.join(about, "msg_id").join(others, "msg_id", "left").groupBy("topic", "other").agg(F.count_distinct("msg_id").alias("messages"))
    return found.orderBy(F.desc("messages"), "topic", F.asc_nulls_last("other")).limit(top)


def related_topics(mentions: DataFrame, about: DataFrame, top: int = 5) -> DataFrame:
    """The topics of every entity's messages, the most frequent ones."""
    n = mentions.join(about, "msg_id").groupBy("entity", "topic").agg(F.count_distinct("msg_id").alias("messages"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("messages"), "topic"))).where(F.col("rank") <= top)


def smart(messages: DataFrame, topics: DataFrame, entities: DataFrame, about: DataFrame, mentions: DataFrame, asked: str, time_words: Sequence[str] = lex.TIME_WORDS, limit: int = 15) -> dict[str, DataFrame]:
    """Routes of a question: linked entities; what is related to the person linked first and who says it; months of
    up to three hit topics if the question asks about time; and always the layered search."""
    linked = entity_link(entities, asked)
    out = {"entities": linked, "context": layered(messages, topics, asked, about, mentions, limit)}
    person = linked.where("type = 'person'").orderBy("rank").first()
    if person:
        out["related"] = related(mentions, about, person["name"])
        out["speakers"] = mentions_by_speaker(messages, person["name"])
        out["pairs"] = conversation_pairs(messages, person["name"])
    if any(w in asked for w in time_words) and "month" in messages.columns:
        hit = topic_hits(topics, asked).orderBy(F.desc("hits"), "topic").limit(3)
        words = topics.join(hit, "topic", "left_semi")
        found = containing(messages.select("msg_id", "month", "content"), words.select("word"), "word").join(words, "word")
        out["temporal"] = found.select("topic", "month", "msg_id").distinct().groupBy("topic", "month").agg(F.count("*").alias("cnt"))
    return out


def social_context(messages: DataFrame, relationships: DataFrame, shared: DataFrame, same_as: DataFrame, person: str) -> dict[str, DataFrame]:
    """What is known about a person: last messages, relationships, shared groups, identity."""
    pair = (F.col("p1") == person) | (F.col("p2") == person)
    identity = same_as.where(F.col("member") == person).select("identity")
    return {
        "last_messages": messages.where(F.col("sender") == person).orderBy(F.desc("msg_id")).limit(5),
        "relationships": relationships.where(pair).orderBy(F.desc("interaction_strength"), "p1", "p2").limit(20),
        "shared_groups": shared.where(pair).orderBy(F.desc(F.col("n1") + F.col("n2")), "source_file", "p1", "p2"),
        "identity": same_as.join(identity, "identity", "left_semi").groupBy("identity").agg(F.sort_array(F.collect_set("member")).alias("members")),
    }
