"""Session state as a fold over turns (the batch twin of the stream)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import rules

#: A session's state before its first turn.
MOOD, INTIMACY = 0.0, 0.5


def fold(turns: DataFrame, session: str) -> DataFrame:
    """(session, mood, intimacy, turn_count, last_topic) after all turns, from rows of (session, turn, delta, text).

    A clamped sum isn't a window sum, so a session's turns are folded in order; they are one row's array.
    """
    kind = "struct<mood:double,intimacy:double,n:bigint,text:string>"
    ordered = turns.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("turn", "delta", "text"))).alias("_turns"))

    def step(s, t):
        mood = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["mood"] + t["delta"]))
        return F.struct(mood.alias("mood"), rules.intimacy_after(s["intimacy"], t["delta"]).alias("intimacy"), (s["n"] + 1).alias("n"), t["text"].alias("text")).cast(kind)

    start = F.struct(F.lit(MOOD).alias("mood"), F.lit(INTIMACY).alias("intimacy"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("text")).cast(kind)
    last = ordered.withColumn("_s", F.aggregate("_turns", start, step))
    return last.select(session, "_s.mood", "_s.intimacy", F.col("_s.n").alias("turn_count"), F.substring("_s.text", 1, 50).alias("last_topic"))


def trajectory(turns: DataFrame, session: str) -> DataFrame:
    """(session, k, mood, intimacy) after each turn. Each session is walked once, so its states cost a row each."""
    kind = turns.schema[session].dataType.simpleString()

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("turn", kind="stable")
        moods, near, mood, intimacy = [], [], MOOD, INTIMACY
        for delta in frame["delta"]:
            mood = max(-1.0, min(1.0, mood + delta))
            intimacy = max(0.0, intimacy - 0.05) if delta < -0.1 else min(1.0, intimacy + 0.03) if delta > 0.05 else intimacy
            moods.append(mood)
            near.append(intimacy)
        return pd.DataFrame({session: frame[session].to_numpy(), "k": range(1, len(frame) + 1), "mood": moods, "intimacy": near})

    return turns.select(session, "turn", "delta").groupBy(session).applyInPandas(walk, f"{session} {kind}, k bigint, mood double, intimacy double")


def status(states: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    """Each asked session's state, or the state before a first turn."""
    joined = sessions.join(states, session, "left")
    return joined.select(session, F.coalesce("mood", F.lit(MOOD)).alias("mood"), F.coalesce("intimacy", F.lit(INTIMACY)).alias("intimacy"), F.coalesce("turn_count", F.lit(0)).alias("turn_count"), F.coalesce("last_topic", F.lit("")).alias("last_topic"))
