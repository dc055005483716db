"""Annotation of messages: what is pending, context, annotators, write-back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.functions import rules


class Annotator(Protocol):
    def annotate(self, messages: DataFrame) -> DataFrame:
        """(msg_id, emotion, intensity, cold_signal) for rows of msg_id and content."""


class RuleAnnotator:
    """The rules, with word lists of one's own."""

    def __init__(self, neutral: Sequence[str] = lex.NEUTRAL_WORDS, warm: Sequence[str] = lex.WARM_WORDS, cold: Sequence[str] = lex.COLD_WORDS, prefix: str = ""):
        self.neutral, self.warm, self.cold, self.prefix = neutral, warm, cold, prefix

    def annotate(self, messages: DataFrame) -> DataFrame:
        c = messages.select("msg_id", rules.classify(F.col("content"), self.neutral, self.warm, self.cold).alias("_c"))
        return c.select("msg_id", F.concat(F.lit(self.prefix), F.col("_c.emotion")).alias("emotion"), "_c.intensity", "_c.cold_signal")


ANNOTATION = "msg_id bigint, emotion string, intensity double, cold_signal boolean, conversation_role string, context_relevance string, persons array<string>"


def number(value: object) -> float:
    """A number of an answer; 0 for what is none."""
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.0


class RemoteAnnotator:
    """Batches of texts through a function of one's own, such as a model's client; tries again with growing pauses.

    ``call`` gets the batch's texts, and with ``contextual`` pairs (context or None, text), each cut to the length that
    a prompt takes; it returns a dictionary for each. Answers are matched by place; those that are missing or can't be read
    get the default, as does a whole batch whose last try fails.
    """

    def __init__(self, call: Callable[[list], list[dict]], batch: int = 10, tries: int = 3, default: str = "neutral", pause: float = 1.0, contextual: bool = False, context_chars: int = 150, text_chars: int = 200):
        self.call, self.batch, self.tries, self.default, self.pause = call, batch, tries, default, pause
        self.contextual, self.context_chars, self.text_chars = contextual, context_chars, text_chars

    def annotate(self, messages: DataFrame) -> DataFrame:
        call, batch, tries, default, pause, contextual = self.call, self.batch, self.tries, self.default, self.pause, self.contextual
        context_chars, text_chars = self.context_chars, self.text_chars

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            def asked(part: pd.DataFrame) -> list:
                texts = [t or "" for t in part["content"].tolist()]
                return [(c[:context_chars] if c else None, t[:text_chars]) for c, t in zip(part["context"].tolist(), texts, strict=True)] if contextual else texts

            for frame in frames:
                for k in range(0, len(frame), batch):
                    part = frame.iloc[k : k + batch]
                    answers: list[dict] = []
                    for attempt in range(tries):
                        try:
                            answers = list(call(asked(part)))
                            break
                        except Exception:
                            if attempt + 1 < tries:
                                time.sleep(pause * 2**attempt)
                    answers = [a if isinstance(a, dict) else {} for a in (answers + [{}] * len(part))[: len(part)]]
                    yield pd.DataFrame(
                        {
                            "msg_id": part["msg_id"].to_numpy(),
                            "emotion": [str(a.get("emotion") or default) for a in answers],
                            "intensity": [number(a.get("intensity", 0.0)) for a in answers],
                            "cold_signal": [bool(a.get("cold_signal", a.get("emotion") == "cold_response")) for a in answers],
                            "conversation_role": [str(a.get("conversation_role") or "response") for a in answers],
                            "context_relevance": [str(a.get("context_relevance") or "unknown") for a in answers],
                            "persons": [[p for p in a.get("persons") or [] if isinstance(p, str) and len(p) >= 2] if isinstance(a.get("persons") or [], list) else [] for a in answers],
                        }
                    )

        return messages.select("msg_id", "content", *(["context"] if contextual else [])).mapInPandas(run, ANNOTATION)


class ContextRules:
    """Annotations with context by rules: the emotion rules, and from the message before what kind of answer it is.

    Without a context a message opens a topic. An acknowledgement acknowledges; warmth, coldness, anger and sadness are
    emotional answers (coldness ends or deflects); a question's answer that shares a word with it is direct; anything
    else shifts the topic. ``names`` are the people looked for.
    """

    def __init__(self, names: Sequence[str] = (), neutral: Sequence[str] = lex.NEUTRAL_WORDS, warm: Sequence[str] = lex.WARM_WORDS, cold: Sequence[str] = lex.COLD_WORDS):
        self.names, self.neutral, self.warm, self.cold = names, neutral, warm, cold

    def annotate(self, messages: DataFrame) -> DataFrame:
        c = messages.select("msg_id", "content", "context", rules.classify(F.col("content"), self.neutral, self.warm, self.cold).alias("_c"))
        emotion, alone = F.col("_c.emotion"), F.coalesce(F.col("context"), F.lit("")) == ""
        pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))
        shares = F.arrays_overlap(pairs(F.col("content")), pairs(F.coalesce("context", F.lit(""))))
        role = F.when(alone, "topic_opener").when(emotion == "cold_response", "deflecting").when(emotion == "neutral_ack", "ending").when(shares | (emotion == "warm_reply"), "response").otherwise("standalone")
        relevance = F.when(alone, "topic_shift").when(emotion == "neutral_ack", "acknowledgment").when(emotion == "cold_response", "deflecting").when(emotion == "warm_reply", "emotional_response").when(shares, "direct_answer").otherwise("topic_shift")
        held = F.filter(F.array(*map(F.lit, sorted(set(self.names)))).cast("array<string>"), lambda n: (F.length(n) >= 2) & F.contains(F.col("content"), n))
        return c.select("msg_id", emotion.alias("emotion"), "_c.intensity", "_c.cold_signal", role.alias("conversation_role"), relevance.alias("context_relevance"), held.alias("persons"))


def mentioned(annotations: DataFrame) -> DataFrame:
    """(msg_id, entity): the people that annotations name, of two characters or more; each pair once."""
    return annotations.select("msg_id", F.explode("persons").alias("entity")).where(F.length("entity") >= 2).distinct()


def pending(messages: DataFrame, annotations: DataFrame, longer_than: int = 0, role: str = "target", boilerplate: Sequence[str] = ()) -> DataFrame:
    """Messages of a role, long enough and without boilerplate, that have no annotation yet."""
    wanted = messages.where((F.col("sender_role") == role) & (F.length("content") > longer_than) & ~rules.any_of(F.col("content"), boilerplate))
    return wanted.join(annotations.select("msg_id"), "msg_id", "left_anti")


def with_context(messages: DataFrame, scope: str = "chat", width: int = 100_000) -> DataFrame:
    """The counterpart's messages with what they answer: the message answered if it is one's own, else one's own
    latest before it, in the chat or (scope "global") anywhere.

    For the global scope messages are put in bands of ``width`` ids; a running maximum over the bands' latest ids gives
    each band what came before it, so no window spans all messages. Windows carry ids, and texts come by a join.
    """
    own = F.when(F.col("sender_role") == "self", F.col("msg_id"))
    by = ["source_file"]
    rows = messages
    if scope != "chat":
        by = ["_band"]
        rows = messages.withColumn("_band", F.floor(F.col("msg_id") / width))
    w = Window.partitionBy(*by).orderBy("msg_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = rows.withColumn("_latest", F.max(own).over(w)).where(F.col("sender_role") == "target")
    if scope != "chat":
        bands = rows.groupBy("_band").agg(F.max(own).alias("_last"))
        before = bands.select("_band", F.max("_last").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        latest = latest.join(before, "_band").withColumn("_latest", F.coalesce("_latest", "_before")).drop("_band", "_before")
    texts = messages.where(F.col("sender_role") == "self").select(F.col("msg_id").alias("_id"), F.col("content").alias("context"))
    answered = texts.select(F.col("_id").alias("reply_to"), F.lit(True).alias("_own"))
    found = latest.join(answered, "reply_to", "left").withColumn("_id", F.when(F.col("_own"), F.col("reply_to")).otherwise(F.col("_latest")))
    return found.drop("_own", "_latest").join(texts, "_id", "left").drop("_id")


def hybrid(messages: DataFrame, quick: Annotator, slow: Annotator, short: int = 8) -> DataFrame:
    """Short texts by one annotator, the others by another."""
    few = F.length("content") <= short
    return quick.annotate(messages.where(few)).withColumn("annotator", F.lit("rules")).unionByName(slow.annotate(messages.where(~few)).withColumn("annotator", F.lit("annotator")), allowMissingColumns=True)


def written_back(old: DataFrame, new: DataFrame) -> DataFrame:
    """New annotations in place of the old ones of the same messages."""
    return old.join(new.select("msg_id"), "msg_id", "left_anti").unionByName(new.dropDuplicates(["msg_id"]), allowMissingColumns=True)


def distribution(annotations: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n) of emotion, conversation_role and context_relevance, or of the given columns."""
    wanted = columns or [c for c in ("emotion", "conversation_role", "context_relevance") if c in annotations.columns]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in wanted)))
    return annotations.select(each.alias("_v")).groupBy("_v.dimension", "_v.value").agg(F.count("*").alias("n"))


def progress(done: int, total: int, seconds: float) -> dict[str, float]:
    """What a run says about itself: rate, share done and seconds left."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"done": done, "total": total, "rate": round(rate, 2), "share": round(done / total, 4) if total else 1.0, "left": round((total - done) / rate, 1) if rate else 0.0}
