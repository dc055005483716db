"""Session state as a stream: each turn updates mood, intimacy, count and topic of its session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from colloquy.functions import lexicon as lex
from colloquy.functions import rules
from colloquy.operators.sessions import INTIMACY, MOOD

STATE = "mood double, intimacy double, turn_count bigint, last_topic string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """The same fold as in the batch; a control row with reset = true puts a session back to its start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", StructType().add("mood", DoubleType()).add("intimacy", DoubleType()).add("turn_count", LongType()).add("last_topic", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mood, near, n, topic = tuple(self.state.get()) if self.state.exists() else (MOOD, INTIMACY, 0, "")
        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for reset, delta, text in zip(turns["reset"], turns["delta"], turns["text"], strict=True):
            if reset:
                mood, near, n, topic = MOOD, INTIMACY, 0, ""
                continue
            mood = max(-1.0, min(1.0, mood + delta))
            near = max(0.0, near - 0.05) if delta < -0.1 else min(1.0, near + 0.03) if delta > 0.05 else near
            n, topic = n + 1, (text or "")[:50]
        self.state.update((mood, near, n, topic))
        yield pd.DataFrame({"session": [key[0]], "mood": [mood], "intimacy": [near], "turn_count": [n], "last_topic": [topic]})

    def close(self) -> None:
        pass


def session_updates(turns: DataFrame, neutral=lex.NEUTRAL_WORDS, warm=lex.WARM_WORDS, cold=lex.COLD_WORDS) -> DataFrame:
    """From a stream of (session, turn, reply, text, reset) each touched session's state, once a micro-batch.

    Needs spark.sql.streaming.stateStore.providerClass = PROVIDER. Turns of a session that come in later
    micro-batches are taken as later turns.
    """
    c = rules.classify(F.coalesce("reply", F.lit("")), neutral, warm, cold)
    rows = turns.withColumn("_c", c).select("session", "turn", rules.mood_delta(F.col("_c.emotion"), F.col("_c.intensity"), F.col("_c.cold_signal")).alias("delta"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("reset", F.lit(False)).alias("reset"))
    return rows.groupBy("session").transformWithStateInPandas(Fold(), f"session string, {STATE}", outputMode="Update", timeMode="None")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Messages by window and chat, with a watermark: late rows up to ``late`` still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "source_file").agg(F.count("*").alias("cnt"))
