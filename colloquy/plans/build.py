"""From chat exports to all graph tables, lazily; each table can be written as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.operators import annotate, edges, entities, facts, graph, relations, resolve, threads
from colloquy.sources import readers


@dataclass(frozen=True)
class Config:
    """Names and word lists of one's own. Topics are (topic, keyword), known names a list."""

    target: str | None = None
    names: tuple[str, ...] = ()
    stop_names: tuple[str, ...] = ()
    generic_names: tuple[str, ...] = lex.GENERIC_NAMES
    topics: tuple[tuple[str, str], ...] = ()
    titles: tuple[str, ...] = lex.TITLES
    fact_rules: tuple[tuple, ...] = lex.FACT_RULES
    annotator: annotate.Annotator | None = None
    threshold: float = 0.75


def messages(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """The exports' messages, numbered over all chats."""
    return threads.renumbered(readers.session_messages(spark, path, config.target), "position").drop("position")


def build(spark: SparkSession, path: str, config: Config = Config()) -> dict[str, DataFrame]:
    """All tables of the exports in a folder: messages, persons, said, reply_to, annotations, mentions, about, knows,
    facts, relationships, pagerank, same_as."""
    rows = messages(spark, path, config).cache()
    people = edges.persons(rows)
    names = spark.createDataFrame([(n,) for n in config.names], "name string")
    found = names.union(entities.titled(rows, config.titles).select("name")).distinct() if config.titles else names
    known = entities.excluded(found, people, (*config.generic_names, *config.stop_names)).cache()
    annotator = config.annotator or annotate.ContextRules(config.names)
    topics = spark.createDataFrame(list(config.topics), "topic string, keyword string")
    mentioned = edges.mentions(rows, known.select(F.col("name").alias("entity"))).cache()
    tied = relations.relationships(rows)
    weighted = tied.select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.col("interaction_strength").alias("weight"))
    counts = mentioned.groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("n"))
    pairs = resolve.candidates(known).cache()
    knows = edges.cooccurrence(mentioned, "msg_id", "entity")
    structure = graph.neighbor_jaccard(knows.select(F.col("p1").alias("src"), F.col("p2").alias("dst")), pairs.select(F.col("e1").alias("p1"), F.col("e2").alias("p2")))
    return {
        "messages": rows,
        "persons": people,
        "said": edges.said_edges(rows, people),
        "reply_to": edges.reply_edges(rows),
        "chats": threads.chat_summary(rows),
        "annotations": annotator.annotate(annotate.with_context(rows)),
        "mentions": mentioned,
        "about": edges.about(rows, topics),
        "knows": knows,
        "facts": facts.numbered(facts.linked(facts.extract(rows, config.fact_rules), rows, people).drop("name")),
        "relationships": tied,
        "pagerank": graph.pagerank(weighted),
        "same_as": resolve.identities(resolve.confirmed(pairs, structure, config.threshold), counts),
    }


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
