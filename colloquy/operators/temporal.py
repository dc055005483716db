"""Activity over months (or days): counts, top lists, lifecycles, turning points, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.threads import display_name


def month_of(formatted: Column) -> Column:
    return F.when(F.length(formatted) >= 7, F.substring(formatted, 1, 7))


def monthly_activity(rows: DataFrame, person: str = "person", month: str = "month", least: int = 3) -> DataFrame:
    return rows.where(F.col(month).isNotNull()).groupBy(person, month).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def monthly_top_n(rows: DataFrame, n: int = 15, least: int = 3) -> DataFrame:
    """Each month's n busiest people, with a bar scaled to the month's busiest."""
    w = Window.partitionBy("month").orderBy(F.desc("cnt"), "person")
    ranked = monthly_activity(rows, least=least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.withColumn("bar", F.floor(F.col("cnt") / F.max("cnt").over(Window.partitionBy("month")) * 30).cast("bigint"))


def lifecycle_counts(rows: DataFrame, warm: Column, cold: Column, least: int = 5) -> DataFrame:
    return rows.groupBy("person", "month").agg(F.count("*").alias("total"), F.count_if(warm).alias("warm"), F.count_if(cold).alias("cold")).where(F.col("total") >= least)


def lifecycle_trend(counts: DataFrame) -> DataFrame:
    """Each kept month against the kept month before: + above 1.3 times, - below 0.7 times, = between."""
    before = F.lag("total").over(Window.partitionBy("person").orderBy("month"))
    trend = F.when(F.col("prev").isNull(), "start").when(F.col("total") > F.col("prev") * 1.3, "up").when(F.col("total") < F.col("prev") * 0.7, "down").otherwise("stable")
    return counts.withColumn("prev", before).withColumn("trend", trend).withColumn("warm_ratio", F.round(F.col("warm") / F.col("total"), 6)).withColumn("cold_ratio", F.round(F.col("cold") / F.col("total"), 6))


def turning_points(trend: DataFrame) -> DataFrame:
    return trend.where((F.col("cold") / F.col("total") > 0.1) & (F.col("prev") > 0) & (F.col("total") < F.col("prev") * 0.7)).select("person", "month", "prev", "total", "cold_ratio")


def person_timeline(rows: DataFrame, top: int = 10) -> DataFrame:
    """The most active people: messages, active months, first and last of them."""
    months = rows.groupBy("person", "month").agg(F.count("*").alias("cnt"))
    return months.groupBy("person").agg(F.sum("cnt").alias("total"), F.count("*").alias("active_months"), F.min("month").alias("first_month"), F.max("month").alias("last_month")).orderBy(F.desc("total"), "person").limit(top)


def group_trend(rows: DataFrame, period: str = "day", least: int = 5, prefixes: Sequence[str] = ("group_",)) -> DataFrame:
    """Groups by period with at least ``least`` messages, each with its group's total over those periods and the name
    that it is shown by."""
    kept = rows.where(F.col("chat_type") == "group").groupBy("source_file", display_name(F.col("source_file"), prefixes).alias("display"), period).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    return kept.withColumn("group_total", F.sum("cnt").over(Window.partitionBy("source_file")))


def spark_line(trend: DataFrame, period: str = "day", high: int = 20, low: int = 5) -> DataFrame:
    """A glyph for each period in order, by two thresholds."""
    glyph = F.when(F.col("cnt") > high, "█").when(F.col("cnt") > low, "▄").otherwise("▁")
    return trend.groupBy("source_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(period).alias("p"), glyph.alias("g")))), lambda x: x["g"]), "").alias("line"))


def timeline_rows(rows: DataFrame, top: int = 500) -> DataFrame:
    return rows.groupBy("person", "month").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "person", "month").limit(top)


def timeline_export(rows: DataFrame, top: int = 500) -> DataFrame:
    """The top rows as one map from month to count for each person."""
    entries = F.array_sort(F.collect_list(F.struct("month", "cnt")))
    return timeline_rows(rows, top).groupBy("person").agg(F.map_from_entries(entries).alias("months"))
