"""People, topics and events named in messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.functions import rules
from colloquy.operators.edges import containing

HAN = r"\x{4e00}-\x{9fff}"


def titled(messages: DataFrame, titles: Sequence[str], least: int = 1) -> DataFrame:
    """(name, role, frequency): up to four word characters before a title, the title included."""
    found = [messages.select(F.explode(F.regexp_extract_all("content", F.lit(rf"([\p{{L}}\p{{N}}_]{{1,4}}){t}"), F.lit(0))).alias("name"), F.lit(t).alias("role")) for t in titles]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("name", "role").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def name_candidates(messages: DataFrame, stop: Sequence[str] = (), forbidden: Sequence[str] = (), letters: str = HAN, shortest: int = 2, longest: int = 3, top: int = 50, least: int = 3) -> DataFrame:
    """Words of two or three letters that stand alone, the most frequent ones without stop names and particles."""
    words = messages.select(F.explode(F.split("content", r"[^\p{L}\p{N}_]+")).alias("name")).where(F.col("name").rlike(f"^[{letters}]{{{shortest},{longest}}}$"))
    fine = words.where(~F.col("name").isin(*stop) & ~rules.any_of(F.col("name"), forbidden))
    return fine.groupBy("name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least).orderBy(F.desc("frequency"), "name").limit(top)


def topic_scores(messages: DataFrame, topics: DataFrame, least: int = 3) -> DataFrame:
    """(topic, mention_score): occurrences of the topic's distinct keywords, without overlaps of one keyword.

    Only messages that hold a keyword are counted through.
    """
    words = containing(messages.select("msg_id", "content"), topics.select("keyword"), "keyword")
    n = F.expr("(length(content) - length(replace(content, keyword, ''))) div length(keyword)")
    scored = words.withColumn("n", n).groupBy("keyword").agg(F.sum("n").alias("n"))
    return scored.join(topics.select("topic", "keyword").distinct(), "keyword").groupBy("topic").agg(F.sum("n").cast("bigint").alias("mention_score")).where(F.col("mention_score") >= least)


def event_spans(messages: DataFrame, events: DataFrame) -> DataFrame:
    """(event, first_mention, last_mention, messages) in the order of messages; events has (event, keyword)."""
    hits = containing(messages.select("msg_id", "formatted_time", "content"), events.select("keyword"), "keyword").join(events.select("event", "keyword").distinct(), "keyword")
    return hits.groupBy("event").agg(F.min_by("formatted_time", "msg_id").alias("first_mention"), F.max_by("formatted_time", "msg_id").alias("last_mention"), F.count_distinct("msg_id").alias("messages"))


def role_conflicts(entities: DataFrame) -> DataFrame:
    """Names with more than one role."""
    role = F.coalesce("role", F.lit("unknown"))
    found = entities.groupBy("name").agg(F.sort_array(F.collect_set(role)).alias("conflicting_roles"))
    return found.withColumn("roles", F.size("conflicting_roles").cast("bigint")).where("roles > 1")


def cooccurring_in_message(messages: DataFrame, entities: DataFrame, first: int | None = None) -> DataFrame:
    """(source_msg_id, from_, to_): people named in the same message; over the first messages only if a number is given."""
    part = messages.select("msg_id", "content")
    m = containing(part.orderBy("msg_id").limit(first) if first else part, entities, "entity").select("msg_id", "entity").distinct()
    return m.select(F.col("msg_id").alias("source_msg_id"), F.col("entity").alias("from_")).join(m.select(F.col("msg_id").alias("source_msg_id"), F.col("entity").alias("to_")), "source_msg_id").where("from_ < to_")


def excluded(entities: DataFrame, participants: DataFrame | None = None, generic: Sequence[str] = lex.GENERIC_NAMES, name: str = "name") -> DataFrame:
    """Entities that are neither a generic reference ("friend", "teacher") nor, where given, a participant (name)."""
    fine = entities.where(~F.col(name).isin(*generic)) if generic else entities
    return fine if participants is None else fine.join(participants.select(F.col("name").alias(name)), name, "left_anti")


def numbered(entities: DataFrame, kind: str) -> DataFrame:
    """Adds entity_id, kind_1, kind_2 and so on in the order of names. Names are counted by their first character
    first, so that no window spans all of them."""
    first = F.substring("name", 1, 1)
    counts = entities.groupBy(first.alias("_c")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_c", "_before")
    order = Window.partitionBy("_c").orderBy("name", *(c for c in entities.columns if c != "name"))
    placed = entities.withColumn("_c", first).join(before, "_c").withColumn("_k", F.row_number().over(order) + F.col("_before"))
    return placed.withColumn("entity_id", F.concat(F.lit(f"{kind}_"), F.col("_k").cast("string"))).drop("_c", "_k", "_before")


def extract_entities(messages: DataFrame, known: DataFrame, titles: Sequence[str], topics: DataFrame, events: DataFrame, participants: DataFrame | None = None, stop: Sequence[str] = (), forbidden: Sequence[str] = (), first: int | None = None) -> dict[str, DataFrame]:
    """All entity tables: persons (known names, titles, and candidates that are neither), topics, events, relations,
    conflicts. Generic references and participants of the conversation are no persons."""
    named = containing(messages.select("msg_id", "content"), known.select(F.col("name").alias("entity")), "entity")
    persons = named.groupBy(F.col("entity").alias("name")).agg(F.count_distinct("msg_id").alias("frequency")).withColumn("role", F.lit(None).cast("string"))
    if titles:
        persons = persons.unionByName(titled(messages, titles))
    others = name_candidates(messages, stop, forbidden).join(persons.select("name"), "name", "left_anti")
    persons = excluded(persons.unionByName(others.withColumn("role", F.lit(None).cast("string"))), participants)
    return {
        "persons": numbered(persons, "person"),
        "topics": topic_scores(messages, topics),
        "events": event_spans(messages, events),
        "relations": cooccurring_in_message(messages, excluded(known, participants).select(F.col("name").alias("entity")), first),
        "disambiguation": role_conflicts(persons.select("name", "role")),
    }
