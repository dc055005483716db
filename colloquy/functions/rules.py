"""Rules on single texts as column expressions: emotion, mood, style, reply scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex


def any_of(text: Column, words: Sequence[str]) -> Column:
    """One of the words is in the text; ``re:`` marks a regular expression."""
    tests = [text.rlike(w[3:]) if w.startswith("re:") else text.contains(w) for w in words]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def classify(text: Column, neutral: Sequence[str] = lex.NEUTRAL_WORDS, warm: Sequence[str] = lex.WARM_WORDS, cold: Sequence[str] = lex.COLD_WORDS) -> Column:
    """struct(emotion, intensity, cold_signal): acknowledgement, warmth, then coldness of short texts."""
    t = F.trim(text)
    is_warm, is_cold, n = any_of(t, warm), any_of(t, cold), F.length(t)

    def result(emotion: str, intensity: float, signal: bool) -> Column:
        return F.struct(F.lit(emotion).alias("emotion"), F.lit(intensity).alias("intensity"), F.lit(signal).alias("cold_signal"))

    return (
        F.when(any_of(t, neutral) & ~is_warm, result("neutral_ack", 0.2, False))
        .when(is_warm, result("warm_reply", 0.5, False))
        .when((n <= 5) & is_cold, result("cold_response", 0.8, True))
        .when((n <= 8) & is_cold, result("cold_response", 0.5, True))
        .otherwise(result("neutral", 0.0, False))
    )


def with_override(rules: Column, other_emotion: Column, other_cold: Column) -> Column:
    """The rules' result; another annotator may only raise the cold signal, and then names the emotion."""
    raised = F.coalesce(other_cold, F.lit(False)) & ~rules["cold_signal"]
    return F.struct(F.when(raised, F.coalesce(other_emotion, rules["emotion"])).otherwise(rules["emotion"]).alias("emotion"), rules["intensity"].alias("intensity"), (rules["cold_signal"] | raised).alias("cold_signal"))


def mood_delta(emotion: Column, intensity: Column, cold: Column) -> Column:
    return F.when(cold, -0.25 * intensity).when(emotion.isin("warm_reply", "joking"), 0.15 * intensity).when(emotion == "angry", -0.3 * intensity).when(emotion == "sad", -0.1 * intensity).otherwise(0.0)


def intimacy_after(intimacy: Column, delta: Column) -> Column:
    return F.when(delta < -0.1, F.greatest(F.lit(0.0), intimacy - 0.05)).when(delta > 0.05, F.least(F.lit(1.0), intimacy + 0.03)).otherwise(intimacy)


@dataclass(frozen=True)
class Style:
    """What a reply must not hold: a mark, self-praise, words that belong to the other side, asides in longer texts."""

    mark: str = lex.FORBIDDEN_MARK
    praise: tuple[str, ...] = lex.PRAISE
    others: tuple[str, ...] = ()
    aside: str = lex.ASIDE


MARK, PRAISE, MISATTRIBUTED, ASIDE = "forbidden_mark", "self_praise", "misattributed", "aside"


def style_issues(text: Column, style: Style = Style()) -> Column:
    tests = [(text.contains(style.mark), MARK), (any_of(text, style.praise), PRAISE), (any_of(text, style.others), MISATTRIBUTED), (text.contains(style.aside) & (F.length(text) > 20), ASIDE)]
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in tests)), lambda x: x.isNotNull())


def style_score(text: Column, style: Style = Style()) -> Column:
    """struct(style_score, issues, passed)."""
    issues = style_issues(text, style)
    n = F.size(issues)
    return F.struct(F.when(n == 0, 5).otherwise(F.greatest(F.lit(1), 5 - 2 * n)).cast("int").alias("style_score"), issues.alias("issues"), (n == 0).alias("passed"))


def should_retry(score: Column) -> Column:
    return ~F.coalesce(score["passed"], F.lit(False)) | (F.coalesce(score["style_score"], F.lit(5)) < 3)


def auto_fix(text: Column, issues: Column, style: Style = Style(), close: str = "）") -> Column:
    """Without the forbidden mark and without asides, where they were found."""
    fixed = F.when(F.array_contains(issues, MARK), F.replace(text, F.lit(style.mark), F.lit(""))).otherwise(text)
    fixed = F.when(F.array_contains(issues, ASIDE), F.regexp_replace(fixed, f"\\Q{style.aside}\\E[^\\Q{close}\\E]*\\Q{close}\\E", "")).otherwise(fixed)
    return F.trim(fixed)


def reply_score(text: Column, style: Style | None = Style()) -> Column:
    """struct(length, style, emoji, composite); without a style checker style is 80."""
    n = F.length(text)
    length = F.when(n <= 0, 0).when(n <= 8, 90).when(n <= 15, 70).when(n <= 30, 50).otherwise(20)
    if style:
        s = style_score(text, style)
        held = F.when(s["passed"], 100).otherwise(20 * s["style_score"])
    else:
        held = F.lit(80)
    marked = text.contains("[") & text.contains("]")
    emoji = F.when(text.contains((style or Style()).mark), 0).when(marked & (n <= 8), 65).when(~marked, 95).otherwise(50)
    return F.struct(length.cast("bigint").alias("length"), held.cast("bigint").alias("style"), emoji.cast("bigint").alias("emoji"), (0.4 * length + 0.4 * held + 0.2 * emoji).alias("composite"))


def session_rules(mood: Column, intimacy: Column) -> Column:
    """Lines of advice for a session's state; empty where nothing applies."""
    return F.concat_ws(
        "\n", F.when(intimacy < 0.3, "RULE: no pet names"), F.when(mood < -0.3, "RULE: at most 8 characters, no emoji"), F.when(mood > 0.3, "STYLE: may be a little warmer")
    )


def strip_fence(text: Column) -> Column:
    """A model's answer without code fences and the word json before it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```\w*\s*|\s*```$", ""), r"^json\s*", ""))
