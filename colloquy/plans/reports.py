"""Runs of evaluation, ablation and reliability, each as one row to be written as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import rules
from colloquy.operators import annotate, evaluate, sessions

DIMENSIONS = ("style", "length", "emotion", "coherence", "relevance")


def evaluation(replies: DataFrame, style: rules.Style = rules.Style(), annotator: annotate.Annotator | None = None, substantive: Sequence[str] = ("direct_answer", "emotional_response", "topic_shift"), emotions: dict | None = None) -> DataFrame:
    """(n, composite_score, style, length, emotion, coherence, relevance) of replies to the same messages.

    replies: (id, context, reply, real), one row for each message answered. Style and length look at the replies; emotion
    holds the replies' cold signals against the real ones'; coherence follows the mood over the replies in the order of
    ids; relevance holds what kind of answer they are against the real ones'. The composite is the mean of the five.
    No row without replies.
    """
    lists = emotions or {}
    texts = replies.select("id", "context", F.col("reply").alias("content"))
    checked = texts.select(rules.style_score(F.col("content"), style).alias("s")).select("s.passed")
    one = texts.withColumn("all", F.lit("all"))
    n = replies.agg(F.count("*").alias("n"))
    r1 = evaluate.compliance(checked)
    r2 = evaluate.length_naturalness(one, "all").drop("all")
    both = replies.select("id", rules.classify(F.col("reply"), **lists).alias("a"), rules.classify(F.col("real"), **lists).alias("b"))
    same = F.avg((F.col("a.cold_signal") == F.col("b.cold_signal")).cast("double"))
    r3 = both.agg(F.round(100 * same, 1).alias("score"), F.round(same, 6).alias("cold_signal_accuracy"))
    turns = both.select(F.lit("all").alias("session"), F.col("id").alias("turn"), rules.mood_delta(F.col("a.emotion"), F.col("a.intensity"), F.col("a.cold_signal")).alias("delta"))
    r4 = evaluate.coherence(sessions.trajectory(turns, "session"), "session", "k").drop("session")
    judge = annotator or annotate.ContextRules(**lists)
    kinds = [judge.annotate(replies.select(F.col("id").alias("msg_id"), "context", F.col(c).alias("content"))).select("msg_id", F.col("context_relevance").alias(c)) for c in ("reply", "real")]
    pairs = kinds[0].join(kinds[1], "msg_id").withColumn("cold", F.lit(True))
    r5 = evaluate.agreement(pairs, "cold", "cold", "reply", "real", substantive).select(F.round("relevance_score", 1).alias("score"), "exact_agreement", "substantive_agreement")
    parts = [part.select(F.struct("*")).scalar().alias(name) for name, part in zip(DIMENSIONS, (r1, r2, r3, r4, r5), strict=True)]  # a row each
    joined = n.where("n > 0").select("n", *parts)
    score = evaluate.composite([F.coalesce(F.col(f"{d}.score"), F.lit(0.0)) for d in DIMENSIONS])
    return joined.select("n", F.round(score, 1).alias("composite_score"), *DIMENSIONS)


def ablation(scores: DataFrame, factors: Sequence[str], score: str = "score") -> DataFrame:
    """(factor, avg_on, avg_off, contribution, full_score): what each component adds to the mean score, and the mean with
    all of them on. scores has a boolean column for each factor."""
    on = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("is_on")) for f in factors)))
    every = F.lit(True)
    for f in factors:
        every = every & F.col(f)
    full = scores.where(every).agg(F.round(F.avg(score), 1)).scalar()
    long = scores.select(on.alias("f"), F.col(score).alias("s")).groupBy("f.factor").agg(F.round(F.avg(F.when(F.col("f.is_on"), F.col("s"))), 1).alias("avg_on"), F.round(F.avg(F.when(~F.col("f.is_on"), F.col("s"))), 1).alias("avg_off"))
    return long.select("factor", F.coalesce("avg_on", F.lit(0.0)).alias("avg_on"), F.coalesce("avg_off", F.lit(0.0)).alias("avg_off"), F.round(F.coalesce("avg_on", F.lit(0.0)) - F.coalesce("avg_off", F.lit(0.0)), 1).alias("contribution"), full.alias("full_score"))


def reliability(ratings: DataFrame, samples: int = 20) -> DataFrame:
    """(dimension, n, pairs, kappa_avg, grade, inconsistent_count, inconsistent_rate, inconsistent_samples) of repeated
    annotations: (item, rater, dimension, label). A row for each dimension."""
    out = evaluate.pairwise_kappa(ratings, "dimension").groupBy("dimension").agg(F.round(F.avg("kappa"), 4).alias("kappa_avg"), F.sort_array(F.collect_list(F.struct(F.concat("r1", F.lit("-"), "r2").alias("pair"), "kappa"))).alias("pairs"))
    items = ratings.groupBy("dimension", "item").agg((F.min("label") != F.max("label")).alias("differs"))
    counts = items.groupBy("dimension").agg(F.count("*").alias("n"), F.count_if("differs").alias("inconsistent_count"))
    first = items.where("differs").withColumn("_k", F.row_number().over(Window.partitionBy("dimension").orderBy("item"))).where(F.col("_k") <= samples)
    listed = first.groupBy("dimension").agg(F.sort_array(F.collect_list("item")).alias("inconsistent_samples"))
    joined = out.join(counts, "dimension").join(listed, "dimension", "left")
    return joined.withColumn("inconsistent_rate", F.round(F.col("inconsistent_count") / F.col("n"), 4)).withColumn("grade", evaluate.kappa_grade(F.col("kappa_avg")))
