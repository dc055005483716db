"""Models behind HTTP: a client of one's own endpoint, and columns that a model answers.

Nothing here is called unless one passes a client or a function; every answer has a default by rules.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.functions import rules

#: Ask(prompts) gives an answer for each, None where there is none.
Ask = Callable[[list[str]], list[str | None]]


def api_key(name: str, files: Sequence[str] = (".env",)) -> str | None:
    """The key of that name: from the environment, else from the first of the files (lines NAME=value) that has it."""
    if os.environ.get(name):
        return os.environ[name]
    for file in map(Path, files):
        for line in file.read_text(encoding="utf-8").splitlines() if file.is_file() else ():
            found, _, value = line.strip().partition("=")
            if found == name and value:
                return value.strip().strip("\"'")
    return None


def unfenced(text: str) -> str:
    """An answer without code fences and the word json before it."""
    return re.sub(r"^json\s*", "", re.sub(r"^```\w*\s*|\s*```$", "", text.strip())).strip()


@dataclass(frozen=True)
class Client:
    """Chat completions at ``url``; it goes to the executors as it is. ``prompt`` is what the model is told before each text."""

    url: str
    model: str = ""
    key: str | None = None
    prompt: str = ""
    max_tokens: int = 40
    temperature: float = 0.1
    tries: int = 3
    pause: float = 1.0
    timeout: float = 30.0

    def sent(self, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", json.dumps(body).encode() if body else None, headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def models(self) -> list[str]:
        """What the endpoint offers; empty where it can't be reached."""
        try:
            return [m["id"] for m in self.sent("models").get("data", [])]
        except (OSError, ValueError, KeyError):
            return []

    def generate(self, text: str, prompt: str | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str:
        """The model's answer; tries again with growing pauses and raises after the last try."""
        told = self.prompt if prompt is None else prompt
        messages = [*([{"role": "system", "content": told}] if told else []), {"role": "user", "content": text}]
        body = {"model": self.model or next(iter(self.models()), ""), "messages": messages, "max_tokens": max_tokens or self.max_tokens, "temperature": max(self.temperature if temperature is None else temperature, 0.05)}
        for attempt in range(self.tries):
            try:
                return unfenced(self.sent("chat/completions", body)["choices"][0]["message"]["content"])
            except (OSError, ValueError, KeyError, IndexError):
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**attempt)
        return ""

    def __call__(self, texts: list[str]) -> list[str | None]:
        return [self.generate(t) for t in texts]

    def annotations(self, texts: list[str]) -> list[dict]:
        """One call for a whole batch, one line of JSON for each text; what can't be read is empty."""
        said = self.generate("\n".join(f"{i + 1}. {t[:200]}" for i, t in enumerate(texts)), max_tokens=self.max_tokens * max(1, len(texts)))
        found = [line for line in said.splitlines() if line.strip()]
        out = []
        for line in found[: len(texts)]:
            try:
                value = json.loads(line.strip().rstrip(","))
            except ValueError:
                value = {}
            out.append(value if isinstance(value, dict) else {})
        return out + [{}] * (len(texts) - len(out))


def answered(rows: DataFrame, prompt: Column, ask: Ask, name: str = "answer", batch: int = 10) -> DataFrame:
    """``rows`` with a column of answers to their prompts, null where the call fails or has none."""
    asked = rows.withColumn(name, prompt.cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list[str | None] = []
            for k in range(0, len(frame), batch):
                part = [p or "" for p in frame[name].iloc[k : k + batch]]
                try:
                    said = list(ask(part))
                except Exception:  # an answer is optional: the caller has a default
                    said = []
                answers += (said + [None] * len(part))[: len(part)]
            frame[name] = pd.Series(answers, index=frame.index, dtype=object)
            yield frame

    return asked.mapInPandas(run, asked.schema)


def style_scores(replies: DataFrame, ask: Ask | None = None, style: rules.Style = rules.Style()) -> DataFrame:
    """(id, style_score, issues, passed): the model's score where it gives one from 1 to 5, else the rules'."""
    scored = replies.select("id", "reply", rules.style_score(F.col("reply"), style).alias("_r"))
    if ask is None:
        return scored.select("id", "_r.*")
    said = F.from_json("_a", "style_score int, issues array<string>, passed boolean")
    fits = F.coalesce(F.col("_s.style_score").between(1, 5), F.lit(False))
    found = answered(scored, F.col("reply"), ask, "_a").withColumn("_s", said)
    return found.select("id", F.when(fits, F.col("_s.style_score")).otherwise(F.col("_r.style_score")).alias("style_score"), F.when(fits, F.coalesce("_s.issues", F.array().cast("array<string>"))).otherwise(F.col("_r.issues")).alias("issues"), F.when(fits, F.coalesce("_s.passed", F.col("_s.style_score") >= 3)).otherwise(F.col("_r.passed")).alias("passed"))


def relevance(pairs: DataFrame, ask: Ask, reply: str = "reply") -> DataFrame:
    """(id, relevance): what kind of answer a reply is, one of the known kinds, else "unknown"."""
    prompt = F.concat(F.lit('Context: "'), F.substring(F.coalesce("context", F.lit("")), 1, 150), F.lit('"\nReply: "'), F.substring(F.coalesce(reply, F.lit("")), 1, 200), F.lit('"'))
    found = answered(pairs.select("id", "context", reply), prompt, ask, "_a")
    said = F.coalesce(F.get_json_object("_a", "$.context_relevance"), F.trim(F.col("_a")))
    return found.select("id", F.when(said.isin(*lex.CONTEXT_RELEVANCE), said).otherwise("unknown").alias("relevance"))


def replies(contexts: DataFrame, ask: Ask, chars: int = 100) -> DataFrame:
    """(id, context, reply): a model's answers to messages, for an evaluation; empty where there is none. The asked model is
    given the message alone, and what it is told besides is the caller's."""
    found = answered(contexts.select("id", "context"), F.substring("context", 1, chars), ask, "reply")
    return found.select("id", "context", F.regexp_replace(F.trim(F.coalesce("reply", F.lit(""))), '^"+|"+$', "").alias("reply"))


def profiles(chunks: DataFrame, by: str, ask: Ask) -> DataFrame:
    """(by, chunk, profile): what a model says about chunks of texts (samples.sample_text), as JSON; null if it is none."""
    found = answered(chunks.select(by, "chunk", "text"), F.col("text"), ask, "_a")
    return found.select(by, "chunk", F.when(F.get_json_object("_a", "$").isNotNull(), F.col("_a")).alias("profile"))
