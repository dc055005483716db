"""Evaluation statistics: agreement, naturalness, coherence, compliance, ablations, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex


def style_stats(messages: DataFrame, by: str, emoji: Column, swear: Column) -> DataFrame:
    return messages.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.length("content")), 6).alias("avg_length"), F.round(F.avg(emoji.cast("double")), 6).alias("emoji_rate"), F.round(F.avg(swear.cast("double")), 6).alias("swear_rate"))


def length_naturalness(replies: DataFrame, by: str, mean: float = lex.REAL_LENGTH_MEAN, std: float = lex.REAL_LENGTH_STD, emoji: float = lex.REAL_EMOJI_RATE) -> DataFrame:
    """How far the lengths' normal distribution is from the real one: 100 exp(-KL)."""
    text = F.col("content")
    spread = F.stddev_pop(F.length(text))
    g = replies.groupBy(by).agg(F.avg(F.length(text)).alias("m"), F.when(spread == 0, 0.5).otherwise(spread).alias("s"), F.avg((text.contains("[") & text.contains("]")).cast("double")).alias("e"))
    kl = F.log(std / F.col("s")) + (F.col("s") * F.col("s") + (F.col("m") - mean) * (F.col("m") - mean)) / (2 * std * std) - 0.5
    k = g.withColumn("kl", kl)
    return k.select(
        by, F.round(F.greatest(F.lit(0.0), 100 * F.exp(-F.col("kl"))), 1).alias("score"), F.round("kl", 4).alias("kl_divergence"), F.round("m", 1).alias("sample_mean"), F.round("s", 1).alias("sample_std"), F.round("e", 3).alias("emoji_rate"), F.round(F.abs(F.col("e") - emoji) * 100, 1).alias("emoji_penalty")
    )


def compliance(scores: DataFrame, passed: str = "passed") -> DataFrame:
    rate = F.avg((~F.col(passed)).cast("double"))
    return scores.agg(F.round(F.greatest(F.lit(0.0), 100 * (1 - 2 * rate)), 1).alias("score"), F.round(rate, 3).alias("forbidden_rate"), F.count_if(~F.col(passed)).alias("violations"), F.count("*").alias("total"))


def coherence(turns: DataFrame, by: str, order: str, mood_jump: float = 0.3, intimacy_jump: float = 0.1) -> DataFrame:
    """100 times one minus the share of jumps in mood and intimacy; 100 with fewer than two turns."""
    w = Window.partitionBy(by).orderBy(order)
    j = turns.withColumn("dm", F.abs(F.col("mood") - F.lag("mood").over(w))).withColumn("di", F.abs(F.col("intimacy") - F.lag("intimacy").over(w)))
    jumps, n = F.count_if(F.col("dm") > mood_jump) + F.count_if(F.col("di") > intimacy_jump), F.count("*")
    return j.groupBy(by).agg(F.when(n < 2, 100.0).otherwise(F.round(100 * (1 - jumps / (2.0 * F.greatest(n - 1, F.lit(1)))), 6)).alias("score"), F.round(F.coalesce(F.max("dm"), F.lit(0.0)), 6).alias("max_mood_jump"))


def agreement(rows: DataFrame, cold_a: str, cold_b: str, label_a: str, label_b: str, substantive: Sequence[str]) -> DataFrame:
    """Accuracy of cold signals, and of labels exactly and as substantive or not, weighed 0.6 and 0.4."""
    same = lambda a, b: F.avg((a == b).cast("double"))
    exact, wide = same(F.col(label_a), F.col(label_b)), same(F.col(label_a).isin(*substantive), F.col(label_b).isin(*substantive))
    return rows.agg(F.round(same(F.col(cold_a), F.col(cold_b)), 6).alias("cold_accuracy"), F.round(exact, 6).alias("exact_agreement"), F.round(wide, 6).alias("substantive_agreement"), F.round(100 * (0.6 * exact + 0.4 * wide), 6).alias("relevance_score"))


def composite(scores: Sequence[Column]) -> Column:
    """The mean of the dimensions' scores, each weighing the same."""
    return sum(scores[1:], scores[0]) / len(scores)


def pairwise_kappa(ratings: DataFrame, *by: str, least: int = 0) -> DataFrame:
    """(r1 < r2, by, n, agreement, kappa) over rows of (item, rater, label, by).

    Chance agreement is the sum over labels of the product of the two raters' shares. Where it is one, kappa is one
    if they agree throughout and else zero.
    """
    a, b = ratings.select("item", *by, F.col("rater").alias("r1"), F.col("label").alias("l1")), ratings.select("item", F.col("rater").alias("r2"), F.col("label").alias("l2"))
    cells = a.join(b, "item").where("r1 < r2").groupBy("r1", "r2", *by, "l1", "l2").agg(F.count("*").alias("c"))
    keys = ["r1", "r2", *by]
    total = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("l1") == F.col("l2"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*keys, F.col("l1").alias("label")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(*keys, F.col("l2").alias("label")).agg(F.sum("c").alias("y"))
    product = left.join(right, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    joined = total.join(product, keys, "left").where(F.col("n") >= least)
    po, pe = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return joined.select(*keys, "n", F.round(po, 4).alias("agreement"), F.round(kappa, 4).alias("kappa"))


def kappa_grade(kappa: Column) -> Column:
    return F.when(kappa >= 0.8, "excellent").when(kappa >= 0.7, "good").when(kappa >= 0.5, "moderate").otherwise("poor")


def disagreements(ratings: DataFrame) -> DataFrame:
    """Items whose raters don't all say the same, with what they say."""
    return ratings.groupBy("item").agg(F.sort_array(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)


def ablation(scores: DataFrame, factors: Sequence[str], score: str = "score") -> DataFrame:
    """Means of all combinations of factors, as a cube: a null factor stands for both of its settings."""
    return scores.cube(*factors).agg(F.round(F.avg(score), 6).alias("mean_score"), F.count("*").alias("n"))


def contributions(scores: DataFrame, factors: Sequence[str], score: str = "score") -> DataFrame:
    """(factor, contribution): the mean with it less the mean without it."""
    on = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("is_on")) for f in factors)))
    long = scores.select(on.alias("f"), F.col(score).alias("s"))
    return long.groupBy("f.factor").agg(F.round(F.avg(F.when(F.col("f.is_on"), F.col("s"))) - F.avg(F.when(~F.col("f.is_on"), F.col("s"))), 6).alias("contribution"))


def history(runs: DataFrame, last: int = 10) -> DataFrame:
    """The last runs with each one's change against the one before."""
    w = Window.orderBy("run")
    recent = runs.orderBy(F.desc("run")).limit(last + 1)
    d = recent.withColumn("delta", F.round(F.col("score") - F.lag("score").over(w), 6)).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("run"))))
    return d.where(F.col("_k") <= last).drop("_k")
