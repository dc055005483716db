"""Facts by pattern rules, anchored at the sender."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.functions import rules

PUNCTUATION = " ,.!?:;\n，。！？：；、"


def found_object(content: Column, patterns: Sequence[str]) -> Column:
    """From five characters before the first pattern (in the rule's order) that matches to thirty behind it, without
    punctuation at the ends; the first fifty characters if none does."""
    out = F.substring(content, 1, 50)
    for p in reversed(patterns):
        if p.startswith("re:"):
            match = F.regexp_extract(content, f"({p[3:]})", 1)
            hit, width = content.rlike(p[3:]), F.length(match)
            at = F.instr(content, match) - 1
        else:
            hit, width, at = content.contains(p), F.lit(len(p)), F.instr(content, p) - 1
        start = F.greatest(at - 5, F.lit(0))
        out = F.when(hit, F.substr(content, start + 1, at + width + 30 - start)).otherwise(out)
    return F.btrim(out, F.lit(PUNCTUATION))


def extract(messages: DataFrame, fact_rules: Sequence[tuple] = lex.FACT_RULES, roles: Sequence[str] = ("target", "self"), confidence: float = 0.9) -> DataFrame:
    """One fact for each message and rule that matches; what a rule forbids takes precedence."""
    content = F.col("content")
    hits = [
        F.when(rules.any_of(content, pos) & ~rules.any_of(content, neg), F.struct(F.lit(i).alias("rule"), F.lit(category).alias("category"), F.lit(predicate).alias("predicate"), found_object(content, pos).alias("object")))
        for i, (category, predicate, pos, neg) in enumerate(fact_rules)
    ]
    rows = messages.where(F.col("sender_role").isin(*roles) & (content != "")).withColumn("_f", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return rows.select("_f.*", F.col("msg_id").alias("source_msg_id"), F.col("sender").alias("subject"), F.col("sender_role").alias("subject_role"), F.lit(float(confidence)).alias("confidence"), F.substring(content, 1, 200).alias("source_content"))


def numbered(facts: DataFrame, width: int = 100_000) -> DataFrame:
    """fact_id F_00001 and so on, in the order of messages and rules. Facts are counted in bands of message ids first, so
    that no window spans all of them."""
    placed = facts.withColumn("_band", F.floor(F.col("source_msg_id") / width))
    counts = placed.groupBy("_band").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_band", "_before")
    k = F.row_number().over(Window.partitionBy("_band").orderBy("source_msg_id", "rule", "subject")) + F.col("_before")
    number = k.cast("string")
    return placed.join(before, "_band").withColumn("fact_id", F.concat(F.lit("F_"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number))).drop("_band", "_before")


def stats(facts: DataFrame) -> DataFrame:
    """Facts of each subject, each subject's category, and all."""
    return facts.rollup("subject", "category").agg(F.count("*").alias("n"))


def best(facts: DataFrame, most: int = 10) -> DataFrame:
    """Each category's surest and longest facts, of those with the same first thirty characters the first."""
    order = [F.desc("confidence"), F.desc(F.length("object")), "source_msg_id", "rule"]
    once = facts.withColumn("_k", F.row_number().over(Window.partitionBy("category", F.substring("object", 1, 30)).orderBy(*order))).where("_k = 1").drop("_k")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("rank") <= most)


def attribution_errors(facts: DataFrame, names_target: Column, mentions_target: Column) -> DataFrame:
    """Facts of the counterpart whose subject lacks their name, and one's own whose subject holds it."""
    error = F.when((F.col("subject_role") == "target") & ~names_target, "target_without_name").when((F.col("subject_role") == "self") & mentions_target, "self_with_target_name")
    return facts.withColumn("error", error).where(F.col("error").isNotNull())


def linked(facts: DataFrame, messages: DataFrame, people: DataFrame) -> DataFrame:
    """Facts whose message and person are there, as edges."""
    there = facts.join(messages.select(F.col("msg_id").alias("source_msg_id")), "source_msg_id", "left_semi")
    return there.join(people.select("name"), F.col("subject") == F.col("name"))
