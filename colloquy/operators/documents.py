"""Markdown documents from facts and contexts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import rules
from colloquy.operators import facts as fact_ops

#: Sections of the memories: heading, categories, facts at most, characters at most, with the predicate in bold.
SECTIONS = (("Preferences", ("preference",), 20, 80, True), ("Study and work", ("attitude",), 15, 100, False), ("About feelings", ("relationship", "self_perception"), 15, 120, False))


def memories(facts: DataFrame, title: str, sections: Sequence[tuple] = SECTIONS) -> DataFrame:
    """(text): one markdown document; each statement names its message. Only the listed top facts meet in one row."""
    parts = None
    for i, (heading, categories, most, chars, bold) in enumerate(sections):
        chosen = fact_ops.best(facts.where(F.col("category").isin(*categories)).withColumn("category", F.lit(heading)), most)
        said = F.substring("object", 1, chars)
        line = F.concat(F.lit("- "), F.concat(F.lit("**"), "predicate", F.lit("**: ")) if bold else F.lit(""), said, F.lit("\n  [msg#"), F.col("source_msg_id").cast("string"), F.lit(", "), "subject", F.lit("]\n"))
        rows = chosen.select(F.lit(i).alias("s"), "rank", line.alias("line"))
        head = facts.sparkSession.createDataFrame([(i, 0, f"---\n\n## {i + 1}. {heading}\n")], "s int, rank int, line string")
        section = head.unionByName(rows)
        parts = section if parts is None else parts.unionByName(section)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "rank", "line"))), lambda x: x["line"]), "\n")
    return parts.agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("text"))


def personas(contexts: DataFrame) -> DataFrame:
    """(entity, text): a short markdown page for each entity of person_context."""
    def listed(heading: str, column: str) -> F.Column:
        lines = F.transform(F.col(column), lambda x: F.concat(F.lit("- "), x["name"].cast("string"), F.lit(" ("), x["n"].cast("string"), F.lit(")")))
        return F.when(F.size(column) > 0, F.concat(F.lit(f"## {heading}\n"), F.array_join(lines, "\n")))

    head = F.concat(F.lit("# "), F.col("entity").cast("string"), F.lit("\n\nmentioned "), F.col("mention_count").cast("string"), F.lit(" times (target "), F.col("by_target").cast("string"), F.lit(", self "), F.col("by_self").cast("string"), F.lit(")"))
    return contexts.select("entity", F.concat_ws("\n\n", head, listed("Topics", "topics"), listed("Mentioned together", "co_occurring")).alias("text"))


#: Sections of a persona: heading, category, words that the predicate holds one of, facts at most, characters at most.
PERSONA = (("Gladness", "emotion", ("开心",), 3, 60), ("Sadness and worry", "emotion", ("难过", "焦虑"), 3, 60), ("On oneself", "self_perception", (), 5, 120), ("On relationships", "relationship", (), 5, 100))


def persona(facts: DataFrame, title: str, sections: Sequence[tuple] = PERSONA) -> DataFrame:
    """(text): what a person's facts say about them, by sections; each statement with its message and confidence, each
    heading with the number of facts behind it. Only the listed top facts meet in one row."""
    parts = None
    for i, (heading, category, words, most, chars) in enumerate(sections):
        held = facts.where((F.col("category") == category) & (rules.any_of(F.col("predicate"), words) if words else F.lit(True)))
        chosen = fact_ops.best(held.withColumn("category", F.lit(heading)), most)
        line = F.concat(F.lit("- **"), "predicate", F.lit("**: "), F.substring("object", 1, chars), F.lit("\n  [confidence "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%, msg#"), F.col("source_msg_id").cast("string"), F.lit("]"))
        rows = chosen.select(F.lit(i).alias("s"), "rank", line.alias("line"))
        head = held.agg(F.concat(F.lit(f"## {i + 1}. {heading} ("), F.count("*").cast("string"), F.lit(" facts)\n")).alias("line")).select(F.lit(i).alias("s"), F.lit(0).alias("rank"), "line")
        section = head.unionByName(rows)
        parts = section if parts is None else parts.unionByName(section)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "rank", "line"))), lambda x: x["line"]), "\n")
    return parts.agg(F.concat(F.lit(f"# {title}\n\n"), body, F.lit("\n\n## Corrections\n\nnone\n")).alias("text"))


def skill(title: str, n_facts: int, sections: Sequence[str]) -> str:
    """A neutral index page of generated documents."""
    return "\n".join([f"# {title}", "", f"Built from {n_facts} facts; every statement names its source message.", "", *(f"- {s}" for s in sections), ""])


def meta(name: str, slug: str, n_facts: int, created_at: str, profile: dict | None = None, tags: dict | None = None) -> dict:
    """What goes beside the documents as meta.json."""
    # The version and the ways that the documents are made.
    out = {"name": name, "slug": slug, "created_at": created_at, "updated_at": created_at, "version": "v1-verified", "source": "structured_fact_database", "total_source_facts": n_facts, "generation_method": "rule_based_extraction_from_original_messages"}
    return out | ({"profile": profile or {}, "tags": tags or {}} if profile is not None or tags is not None else {})


def summary(contexts: DataFrame, top: int = 3) -> DataFrame:
    """(name, mentions, top_topics, top_co_occurring): a line for each entity of person_context."""
    first = lambda c: F.transform(F.slice(F.coalesce(F.col(c), F.array().cast(contexts.schema[c].dataType)), 1, top), lambda x: x["name"].cast("string"))
    return contexts.select(F.col("entity").cast("string").alias("name"), F.col("mention_count").alias("mentions"), first("topics").alias("top_topics"), first("co_occurring").alias("top_co_occurring"))


def write_personas(contexts: DataFrame, path: str) -> None:
    """A page for each entity, in a folder named after it (slashes and spaces as underscores), and _summary as JSON lines."""
    slug = F.regexp_replace(F.col("entity").cast("string"), "[ /]", "_")
    personas(contexts).select(slug.alias("slug"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("slug").text(f"{path}/pages")
    summary(contexts).write.mode("overwrite").json(f"{path}/_summary")


def write_documents(spark: SparkSession, facts: DataFrame, name: str, slug: str, path: str, created_at: str, **extra: dict) -> None:
    """memories, persona, skill and meta of a person's facts, each in a folder of its own."""
    n = facts.count()
    memories(facts, name).select(F.col("text").alias("value")).write.mode("overwrite").text(f"{path}/memories")
    persona(facts, name).select(F.col("text").alias("value")).write.mode("overwrite").text(f"{path}/persona")
    spark.createDataFrame([(skill(name, n, [s[0] for s in SECTIONS]),)], "value string").write.mode("overwrite").text(f"{path}/skill")
    spark.createDataFrame([(json.dumps(meta(name, slug, n, created_at, **extra), ensure_ascii=False),)], "value string").write.mode("overwrite").text(f"{path}/meta")
