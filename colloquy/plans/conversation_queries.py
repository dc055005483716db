"""Queries over the conversations' messages: parsing, graph tables, samples, context, stylistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.functions import rules
from colloquy.operators import annotate, edges, entities, evaluate, facts, resolve, samples, search, sessions, threads
from colloquy.sources.adapters import C_SQL, E_REPLY_SQL, conversation_messages, event_messages

QUERIES, ORACLE = {}, {}

#: Lexicons for the tables' invented text (the engine's defaults are in functions.lexicon).
NEUTRAL, WARM, COLD = ("the", "la"), ("of", "to"), ("In", "an", "er")
TOPICS = (("motion", "tion"), ("motion", "ing"), ("motion", "with"), ("place", "from"), ("place", "the "), ("time", "was"), ("time", "und"), ("time", "que"))
NAMES = ("ther", "ering", "tion", "shha", "ndble", "que", "ment")
RULES = (("preference", "likes", ("that",), ("was",)), ("emotion", "glad", ("with", "ndble"), ("for",)), ("attitude", "of work", ("from the", "on"), ()), ("self", "describes", ("is",), ("are", "it")))


def lexicon_sql(name: str, column: str, values) -> str:
    return f"{name}({column}) AS (VALUES {', '.join(str(v) if isinstance(v, tuple) else f'({v!r})' for v in values)})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def threaded(spark: SparkSession, d: str) -> DataFrame:
    return threads.reply_chain(conversation_messages(spark, d))


CR_SQL = C_SQL + """,
cr AS (SELECT *, CASE WHEN p_role IS NOT NULL AND p_role <> sender_role THEN p_id END AS reply_to FROM
    (SELECT *, lag(msg_id) OVER w AS p_id, lag(sender_role) OVER w AS p_role FROM c WINDOW w AS (PARTITION BY source_file ORDER BY msg_id)))"""


@query(
    """WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'system' ELSE 'text' END AS msg_type, CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN user_id % 2 ELSE 0 END AS is_send,
    event_type = 'click' AS grp, CASE WHEN user_id % 3 = 0 THEN '' ELSE ' u' || user_id || chr(10) END AS sender_name FROM events)
SELECT event_id AS msg_id, CASE WHEN msg_type = 'system' THEN 'system' WHEN grp AND is_send = 0 THEN 'group_member' WHEN is_send = 0 THEN 'target' WHEN is_send = 1 THEN 'self' ELSE 'unknown' END AS sender_role,
    replace(trim(CASE WHEN sender_name <> '' THEN sender_name WHEN msg_type = 'system' THEN 'system' WHEN is_send = 0 THEN 'peer' WHEN is_send = 1 THEN 'me' ELSE 'unknown' END, ' ' || chr(10)), chr(10), '') AS sender FROM x"""
)
def role_normalize(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "user_id")
    rows = e.select(
        F.col("event_id").alias("msg_id"),
        F.when(F.col("event_type") == "error", "system").otherwise("text").alias("msg_type"),
        F.when(F.col("event_type") == "signup", F.lit(None)).when(F.col("event_type") == "view", F.col("user_id") % 2).otherwise(0).alias("is_send"),
        (F.col("event_type") == "click").alias("grp"),
        F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit("\n"))).alias("sender_name"),
    )
    return threads.normalize_roles(rows, F.lit("peer"), F.lit("me"), F.col("grp")).select("msg_id", "sender_role", "sender")


@query(f"WITH {C_SQL} SELECT msg_id, content FROM c WHERE sender_role <> 'system' AND content <> ''")
def text_only(spark, d):
    m = conversation_messages(spark, d).withColumn("msg_type", F.when(F.col("sender_role") == "system", "system").otherwise("text"))
    return threads.text_only(m).select("msg_id", "content")


@query(f"WITH {CR_SQL} SELECT msg_id, reply_to FROM cr UNION ALL SELECT * FROM (WITH {E_REPLY_SQL} SELECT -msg_id - 1, reply_to FROM er)")
def reply_chain(spark, d):
    e = threads.reply_chain(event_messages(spark, d)).select((-F.col("msg_id") - 1).alias("msg_id"), "reply_to")
    return threaded(spark, d).select("msg_id", "reply_to").union(e)


@query(
    f"""WITH {CR_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY source_file, msg_id) AS new_id FROM cr)
SELECT n.new_id AS msg_id, r.new_id AS reply_to, n.content FROM n LEFT JOIN n r ON n.reply_to = r.msg_id"""
)
def renumber(spark, d):
    return threads.renumbered(threaded(spark, d), "msg_id").select("msg_id", "reply_to", "content")


P_SQL = "p AS (SELECT * REPLACE ('p' || (conv_id % 10) AS sender) FROM c)"


def p_variant(spark, d):
    return conversation_messages(spark, d).withColumn("sender", F.concat(F.lit("p"), (F.col("conv_id") % 10).cast("string")))


@query(f"WITH {C_SQL}, {P_SQL} SELECT sender AS name, CASE min(CASE sender_role WHEN 'target' THEN 1 WHEN 'self' THEN 2 WHEN 'group_member' THEN 3 WHEN 'system' THEN 4 END) WHEN 1 THEN 'target' WHEN 2 THEN 'self' WHEN 3 THEN 'group_member' ELSE 'system' END AS role FROM p GROUP BY sender")
def persons(spark, d):
    return edges.persons(p_variant(spark, d))


@query(f"WITH {C_SQL} SELECT sender AS name, msg_id FROM c")
def said_edges(spark, d):
    m = conversation_messages(spark, d)
    return edges.said_edges(m, edges.persons(m))


@query(f"WITH {CR_SQL} SELECT a.msg_id AS src, a.reply_to AS dst FROM cr a JOIN cr b ON a.reply_to = b.msg_id")
def reply_edges(spark, d):
    return edges.reply_edges(threaded(spark, d))


@query(f"WITH {C_SQL} SELECT source_file, count(*) AS total, count(*) FILTER (sender_role = 'target') AS target, count(*) FILTER (sender_role = 'self') AS self, count(*) FILTER (sender_role = 'system') AS system, arg_min(sender, msg_id) FILTER (sender_role = 'self') AS self_name FROM c GROUP BY source_file")
def chat_summary(spark, d):
    return threads.chat_summary(conversation_messages(spark, d))


ANNOTATED = "a AS (SELECT msg_id FROM c WHERE contains(content, 'tion'))"


@query(f"WITH {C_SQL}, {ANNOTATED} SELECT msg_id, content FROM c WHERE length(content) > 40 AND sender_role = 'target' AND msg_id NOT IN (SELECT msg_id FROM a)")
def pending_annotations(spark, d):
    m = conversation_messages(spark, d)
    return annotate.pending(m, m.where("contains(content, 'tion')").select("msg_id"), longer_than=40).select("msg_id", "content")


@query(f"WITH {C_SQL} SELECT msg_id, bucket FROM (SELECT msg_id, CASE WHEN length(content) <= 150 THEN 'short' WHEN length(content) <= 400 THEN 'medium' ELSE 'long' END AS bucket, row_number() OVER (PARTITION BY CASE WHEN length(content) <= 150 THEN 'short' WHEN length(content) <= 400 THEN 'medium' ELSE 'long' END ORDER BY md5('0:' || msg_id), msg_id) AS k FROM c) WHERE k <= 33")
def stratified_sample(spark, d):
    return samples.stratified(conversation_messages(spark, d), 100, short=150, medium=400).select("msg_id", "bucket")


@query(f"WITH {CR_SQL} SELECT t.msg_id AS her_mid, s.msg_id AS his_mid, s.content AS his_msg, t.content AS her_reply FROM cr t JOIN cr s ON t.reply_to = s.msg_id WHERE t.sender_role = 'target' AND s.sender_role = 'self' AND length(t.content) > 3 AND length(s.content) > 3 ORDER BY md5('0:' || t.msg_id), t.msg_id LIMIT 20")
def reply_pair_sample(spark, d):
    return samples.reply_pairs(threaded(spark, d), 20).select("her_mid", "his_mid", "his_msg", "her_reply")


@query(f"WITH {C_SQL} SELECT msg_id, content FROM c WHERE sender_role = 'target' AND length(content) > 5 ORDER BY msg_id LIMIT 50 OFFSET 100")
def paged_scan(spark, d):
    return samples.page(conversation_messages(spark, d), 50, 100).select("msg_id", "content")


@query(
    f"""WITH {C_SQL}, v AS (SELECT * REPLACE (CASE WHEN turn % 3 = 0 THEN 'self' ELSE 'target' END AS sender_role) FROM c),
r AS (SELECT *, CASE WHEN lag(sender_role) OVER w <> sender_role THEN lag(msg_id) OVER w END AS reply_to FROM v WINDOW w AS (PARTITION BY source_file ORDER BY msg_id)),
f AS (SELECT *, last_value(CASE WHEN sender_role = 'self' THEN content END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fallback FROM r)
SELECT f.msg_id, coalesce(CASE WHEN p.sender_role = 'self' THEN p.content END, f.fallback) AS context FROM f LEFT JOIN r p ON f.reply_to = p.msg_id WHERE f.sender_role = 'target'"""
)
def context_asof(spark, d):
    v = conversation_messages(spark, d).withColumn("sender_role", F.when(F.col("turn") % 3 == 0, "self").otherwise("target"))
    return annotate.with_context(threads.reply_chain(v)).select("msg_id", "context")


# ---- emotion, mood, style

def like_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {w!r})" for w in words) + ")"


EMO_SQL = f"""{C_SQL}, cut AS (SELECT msg_id, conv_id, turn, trim(content) AS t FROM c),
emo AS (SELECT *, CASE WHEN {like_any("t", NEUTRAL)} AND NOT {like_any("t", WARM)} THEN 'neutral_ack' WHEN {like_any("t", WARM)} THEN 'warm_reply' WHEN length(t) <= 8 AND {like_any("t", COLD)} THEN 'cold_response' ELSE 'neutral' END AS emotion,
    CASE WHEN {like_any("t", NEUTRAL)} AND NOT {like_any("t", WARM)} THEN 0.2 WHEN {like_any("t", WARM)} THEN 0.5 WHEN length(t) <= 5 AND {like_any("t", COLD)} THEN 0.8 WHEN length(t) <= 8 AND {like_any("t", COLD)} THEN 0.5 ELSE 0.0 END::DOUBLE AS intensity FROM cut),
emo2 AS (SELECT *, emotion = 'cold_response' AS cold_signal FROM emo)"""


def classified(spark, d):
    """Whole texts by the rules; that short ones may be cold is left to the unit tests, as these texts are longer."""
    c = conversation_messages(spark, d).withColumn("t", F.trim("content"))
    return c.withColumn("c", rules.classify(F.col("t"), NEUTRAL, WARM, COLD)).select("msg_id", "conv_id", "turn", "t", "c.*")


@query(f"WITH {EMO_SQL} SELECT msg_id, emotion, intensity, cold_signal FROM emo2")
def emotion_rules(spark, d):
    return classified(spark, d).select("msg_id", "emotion", "intensity", "cold_signal")


@query(f"WITH {EMO_SQL} SELECT msg_id, round(CASE WHEN cold_signal THEN -0.25 * intensity WHEN emotion = 'warm_reply' THEN 0.15 * intensity WHEN emotion = 'angry' THEN -0.3 * intensity WHEN emotion = 'sad' THEN -0.1 * intensity ELSE 0 END, 6) AS delta FROM (SELECT * REPLACE (CASE WHEN emotion = 'neutral' AND msg_id % 2 = 0 THEN 'sad' WHEN emotion = 'neutral' THEN 'angry' ELSE emotion END AS emotion, CASE WHEN emotion = 'neutral' THEN 0.5 ELSE intensity END AS intensity) FROM emo2)")
def mood_delta(spark, d):
    x = classified(spark, d)
    plain = F.col("emotion") == "neutral"
    x = x.withColumn("intensity", F.when(plain, 0.5).otherwise(F.col("intensity"))).withColumn("emotion", F.when(plain & (F.col("msg_id") % 2 == 0), "sad").when(plain, "angry").otherwise(F.col("emotion")))
    return x.select("msg_id", F.round(rules.mood_delta(F.col("emotion"), F.col("intensity"), F.col("cold_signal")), 6).alias("delta"))


FOLD_SQL = (
    f"WITH RECURSIVE {EMO_SQL}"
    + """, s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, t,
    CASE WHEN cold_signal THEN -0.25 * intensity WHEN emotion = 'warm_reply' THEN 0.15 * intensity ELSE 0 END::DOUBLE AS delta FROM emo2),
f AS (SELECT conv_id, 0::BIGINT AS k, 0.0::DOUBLE AS mood, 0.5::DOUBLE AS intimacy, 0.0::DOUBLE AS delta, '' AS t FROM (SELECT DISTINCT conv_id FROM s)
    UNION ALL SELECT f.conv_id, s.k, greatest(-1.0, least(1.0, f.mood + s.delta)), CASE WHEN s.delta < -0.1 THEN greatest(0.0, f.intimacy - 0.05) WHEN s.delta > 0.05 THEN least(1.0, f.intimacy + 0.03) ELSE f.intimacy END, s.delta, s.t
    FROM f JOIN s ON f.conv_id = s.conv_id AND s.k = f.k + 1)"""
)


def session_turns(spark, d):
    x = classified(spark, d)
    delta = rules.mood_delta(F.col("emotion"), F.col("intensity"), F.col("cold_signal"))
    return x.select("conv_id", "turn", delta.alias("delta"), F.col("t").alias("text"))


@query(FOLD_SQL + " SELECT conv_id, k, round(mood, 6) AS mood, round(intimacy, 6) AS intimacy FROM f WHERE k > 0")
def mood_trajectory(spark, d):
    return sessions.trajectory(session_turns(spark, d), "conv_id").select("conv_id", "k", F.round("mood", 6).alias("mood"), F.round("intimacy", 6).alias("intimacy"))


@query(FOLD_SQL + " SELECT conv_id, round(arg_max(mood, k), 3) AS mood, round(arg_max(intimacy, k), 3) AS intimacy, max(k) AS turn_count, arg_max(substr(t, 1, 50), k) AS last_topic FROM f GROUP BY conv_id")
def session_fold(spark, d):
    return sessions.fold(session_turns(spark, d), "conv_id").select("conv_id", F.round("mood", 3).alias("mood"), F.round("intimacy", 3).alias("intimacy"), "turn_count", "last_topic")


@query(
    FOLD_SQL
    + """, v AS (SELECT conv_id, k, round(mood * 8, 6) AS mood, round(intimacy * 8, 6) AS intimacy FROM f WHERE k > 0),
j AS (SELECT *, abs(mood - lag(mood) OVER w) AS dm, abs(intimacy - lag(intimacy) OVER w) AS di, count(*) OVER (PARTITION BY conv_id) AS n FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id, CASE WHEN max(n) < 2 THEN 100.0 ELSE round(100 * (1 - (count(*) FILTER (dm > 0.3) + count(*) FILTER (di > 0.1)) / (2.0 * (max(n) - 1))), 6) END AS score, round(coalesce(max(dm), 0), 6) AS max_mood_jump FROM j GROUP BY conv_id"""
)
def coherence(spark, d):
    t = sessions.trajectory(session_turns(spark, d), "conv_id").select("conv_id", "k", F.round(F.col("mood") * 8, 6).alias("mood"), F.round(F.col("intimacy") * 8, 6).alias("intimacy"))
    return evaluate.coherence(t, "conv_id", "k")


@query(f"WITH {C_SQL} SELECT sender, count(*) AS n, round(avg(length(content)), 6) AS avg_length, round(avg((contains(content, 'tion') AND contains(content, 'ing'))::INT), 6) AS emoji_rate, round(avg({like_any('content', ('was', 'que'))}::INT), 6) AS swear_rate FROM c GROUP BY sender")
def style_stats(spark, d):
    emoji = F.col("content").contains("tion") & F.col("content").contains("ing")
    return evaluate.style_stats(conversation_messages(spark, d), "sender", emoji, rules.any_of(F.col("content"), ("was", "que")))


@query(
    f"""WITH {C_SQL}, cut AS (SELECT msg_id, content || CASE WHEN turn % 4 = 0 THEN '[x]' WHEN turn % 4 = 1 THEN '[bad]' ELSE '' END AS t FROM c),
p AS (SELECT *, CASE WHEN length(t) <= 0 THEN 0 WHEN length(t) <= 8 THEN 90 WHEN length(t) <= 15 THEN 70 WHEN length(t) <= 30 THEN 50 ELSE 20 END AS len_s,
  contains(t, '[bad]')::INT + contains(t, 'the')::INT + contains(t, 'tion')::INT + (contains(t, 'e') AND length(t) > 20)::INT AS bad,
  CASE WHEN contains(t, '[bad]') THEN 0 WHEN contains(t, '[') AND contains(t, ']') AND length(t) <= 8 THEN 65 WHEN NOT (contains(t, '[') AND contains(t, ']')) THEN 95 ELSE 50 END AS emo_s FROM cut)
SELECT msg_id, len_s::BIGINT AS length_score, (CASE WHEN bad = 0 THEN 100 ELSE 20 * greatest(1, 5 - 2 * bad) END)::BIGINT AS style_score, emo_s::BIGINT AS emoji_score, round(0.4 * len_s + 0.4 * (CASE WHEN bad = 0 THEN 100 ELSE 20 * greatest(1, 5 - 2 * bad) END) + 0.2 * emo_s, 6) AS composite FROM p"""
)
def reply_score(spark, d):
    mark = F.when(F.col("turn") % 4 == 0, "[x]").when(F.col("turn") % 4 == 1, "[bad]").otherwise("")
    t = conversation_messages(spark, d).select("msg_id", F.concat("content", mark).alias("t"))
    style = rules.Style("[bad]", ("the",), ("tion",), "e")
    s = t.withColumn("s", rules.reply_score(F.col("t"), style))
    return s.select("msg_id", F.col("s.length").alias("length_score"), F.col("s.style").alias("style_score"), F.col("s.emoji").alias("emoji_score"), F.round("s.composite", 6).alias("composite"))


NAT_SQL = """g AS (SELECT sender, avg(length(content)) AS m, CASE WHEN stddev_pop(length(content)) = 0 THEN 0.5 ELSE stddev_pop(length(content)) END AS s, avg((contains(content, '[') AND contains(content, ']'))::INT) AS er FROM c GROUP BY sender),
kl AS (SELECT *, ln(500.0::DOUBLE / s) + (s * s + (m - 400.0::DOUBLE) * (m - 400.0::DOUBLE)) / (2 * 500.0::DOUBLE * 500.0::DOUBLE) - 0.5 AS kl FROM g)
SELECT sender, round(greatest(0, 100 * exp(-kl)), 1) AS score, round(kl, 4) AS kl_divergence, round(m, 1) AS sample_mean, round(s, 1) AS sample_std, round(er, 3) AS emoji_rate, round(abs(er - 0.056) * 100, 1) AS emoji_penalty FROM kl"""


@query(f"WITH {C_SQL}, {NAT_SQL}")
def length_naturalness(spark, d):
    return evaluate.length_naturalness(conversation_messages(spark, d), "sender", mean=400.0, std=500.0)


OTHER_NEUTRAL, OTHER_WARM = ("and", "est"), ("of", "que")


def other_sql(t: str) -> str:
    return f"CASE WHEN {like_any(t, OTHER_NEUTRAL)} AND NOT {like_any(t, OTHER_WARM)} THEN 'neutral_ack' WHEN {like_any(t, OTHER_WARM)} THEN 'warm_reply' ELSE 'neutral' END"


@query(
    f"""WITH {EMO_SQL}, w AS (SELECT emotion = 'warm_reply' AS a, {other_sql('t')} = 'warm_reply' AS b, emotion AS r1, {other_sql('t')} AS r2 FROM emo2)
SELECT round(avg((a = b)::INT), 6) AS cold_accuracy, round(avg((r1 = r2)::INT), 6) AS exact_agreement, round(avg(((r1 IN ('warm_reply', 'cold_response')) = (r2 IN ('warm_reply', 'cold_response')))::INT), 6) AS substantive_agreement,
  round(100 * (0.6 * avg((r1 = r2)::INT) + 0.4 * avg(((r1 IN ('warm_reply', 'cold_response')) = (r2 IN ('warm_reply', 'cold_response')))::INT)), 6) AS relevance_score FROM w"""
)
def agreement_accuracy(spark, d):
    other = rules.classify(F.col("t"), OTHER_NEUTRAL, OTHER_WARM, ())
    x = classified(spark, d).withColumn("o", other).select((F.col("emotion") == "warm_reply").alias("a"), (F.col("o.emotion") == "warm_reply").alias("b"), F.col("emotion").alias("r1"), F.col("o.emotion").alias("r2"))
    return evaluate.agreement(x, "a", "b", "r1", "r2", ("warm_reply", "cold_response"))


@query(f"WITH {EMO_SQL} SELECT msg_id, CASE WHEN length(t) <= 200 THEN emotion ELSE 'model:' || emotion END AS emotion, CASE WHEN length(t) <= 200 THEN 'rules' ELSE 'annotator' END AS annotator FROM emo2")
def hybrid_annotate(spark, d):
    t = conversation_messages(spark, d).select("msg_id", F.trim("content").alias("content"))
    quick = annotate.RuleAnnotator(NEUTRAL, WARM, COLD)
    return annotate.hybrid(t, quick, annotate.RuleAnnotator(NEUTRAL, WARM, COLD, prefix="model:"), short=200).select("msg_id", "emotion", "annotator")


# ---- facts

RULE_ROWS = ", ".join(f"({i}, {c!r}, {p!r}, {like_any('content', pos)}, {like_any('content', neg) if neg else 'FALSE'}, [{', '.join(map(repr, pos))}])" for i, (c, p, pos, neg) in enumerate(RULES))
FACT_SQL = (
    C_SQL
    + ",\nfr AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS rule, {c!r} AS category, {p!r} AS predicate, msg_id, sender, sender_role, content, [{', '.join(map(repr, pos))}] AS pats FROM c WHERE sender_role IN ('target', 'self') AND content <> '' AND {like_any('content', pos)}"
        + (f" AND NOT {like_any('content', neg)}" if neg else "")
        for i, (c, p, pos, neg) in enumerate(RULES)
    )
    + "),\nfx AS (SELECT *, list_filter(pats, lambda x: contains(content, x))[1] AS pat FROM fr),\n"
    + "fo AS (SELECT *, strpos(content, pat) - 1 AS p0 FROM fx),\n"
    + "fa AS (SELECT rule, category, predicate, msg_id, sender AS subject, sender_role AS subject_role, trim(substr(content, greatest(p0 - 5, 0) + 1, p0 + length(pat) + 30 - greatest(p0 - 5, 0)), ' ,.!?:;' || chr(10)) AS object, substr(content, 1, 200) AS source_content FROM fo)"
)


def extracted(spark, d):
    return facts.extract(conversation_messages(spark, d), RULES)


@query(f"WITH {FACT_SQL} SELECT category, predicate, msg_id AS source_msg_id, subject, subject_role, 0.9::DOUBLE AS confidence, source_content FROM fa")
def facts_(spark, d):
    return extracted(spark, d).select("category", "predicate", "source_msg_id", "subject", "subject_role", "confidence", "source_content")


QUERIES["facts"], ORACLE["facts"] = QUERIES.pop("facts_"), ORACLE.pop("facts_")


@query(f"WITH {FACT_SQL} SELECT msg_id AS source_msg_id, predicate, object FROM fa")
def fact_objects(spark, d):
    return extracted(spark, d).select("source_msg_id", "predicate", "object")


@query(f"WITH {FACT_SQL} SELECT subject, category, count(*) AS n FROM fa GROUP BY ROLLUP (subject, category)")
def fact_stats(spark, d):
    return facts.stats(extracted(spark, d))


@query(
    f"""WITH {FACT_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY category, substr(object, 1, 30) ORDER BY length(object) DESC, msg_id, rule) AS k FROM fa),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY length(object) DESC, msg_id, rule) AS rank FROM o WHERE k = 1) SELECT category, rank, msg_id AS source_msg_id, object FROM b WHERE rank <= 10"""
)
def best_facts(spark, d):
    return facts.best(extracted(spark, d), 10).select("category", "rank", "source_msg_id", "object")


@query(
    f"""WITH {FACT_SQL}, x AS (SELECT * REPLACE (CASE WHEN msg_id % 11 = 0 THEN 'user_' || subject ELSE subject END AS subject) FROM fa)
SELECT msg_id AS source_msg_id, subject, subject_role, CASE WHEN subject_role = 'target' THEN 'target_without_name' ELSE 'self_with_target_name' END AS error FROM x
WHERE (subject_role = 'target' AND NOT starts_with(subject, 'assistant')) OR (subject_role = 'self' AND contains(subject, 'assistant'))"""
)
def attribution_check(spark, d):
    x = extracted(spark, d).withColumn("subject", F.when(F.col("source_msg_id") % 11 == 0, F.concat(F.lit("user_"), F.col("subject"))).otherwise(F.col("subject")))
    return facts.attribution_errors(x, F.col("subject").startswith("assistant"), F.col("subject").contains("assistant")).select("source_msg_id", "subject", "subject_role", "error")


@query(f"WITH {FACT_SQL} SELECT msg_id AS source_msg_id, predicate, sender AS name FROM (SELECT DISTINCT fa.msg_id, fa.predicate, c.sender FROM fa JOIN c ON fa.msg_id = c.msg_id AND fa.subject = c.sender)")
def fact_edges(spark, d):
    m = conversation_messages(spark, d)
    return facts.linked(extracted(spark, d), m, edges.persons(m)).select("source_msg_id", "predicate", "name")


# ---- search

T_SQL = "t(topic, word) AS (VALUES " + ", ".join(f"({a!r}, {b!r})" for a, b in TOPICS) + ")"
ASK = "with motion and tion from the place"
EXP_SQL = f"""{T_SQL}, hit AS (SELECT topic, count(*) AS hits, min(pos) AS pos FROM (SELECT *, row_number() OVER () AS pos FROM t) WHERE contains({ASK!r}, word) GROUP BY topic),
ord AS (SELECT *, row_number() OVER (ORDER BY hits DESC, topic) AS r FROM hit),
kw AS (SELECT word, min(CASE WHEN r = 1 THEN 1 ELSE 2 END) AS layer FROM t JOIN ord USING (topic) GROUP BY word)"""


def topic_table(spark):
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TOPICS)], "pos int, topic string, word string")


@query(f"WITH {EXP_SQL} SELECT word, layer FROM kw")
def expand_keywords(spark, d):
    return search.expand(topic_table(spark), ASK).select("word", "layer")


MEN_SQL = "names(entity) AS (VALUES " + ", ".join(f"({n!r})" for n in NAMES) + "), men AS (SELECT DISTINCT msg_id, entity FROM c JOIN names ON contains(content, entity))"
ABO_SQL = "abo AS (SELECT DISTINCT msg_id, topic FROM c JOIN t ON contains(content, word))"


def entity_table(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "entity string")


@query(f"WITH {C_SQL}, {MEN_SQL} SELECT msg_id, entity FROM men")
def mentions(spark, d):
    return edges.mentions(conversation_messages(spark, d), entity_table(spark))


@query(f"WITH {C_SQL}, {T_SQL}, {ABO_SQL} SELECT msg_id, topic FROM abo")
def about(spark, d):
    return edges.about(conversation_messages(spark, d), topic_table(spark).select("topic", F.col("word").alias("keyword")))


@query(
    f"""WITH {C_SQL}, {EXP_SQL}, {ABO_SQL}, {MEN_SQL}, few AS (SELECT * FROM c),
l1 AS (SELECT DISTINCT msg_id, 1 AS layer FROM few JOIN kw ON kw.layer = 1 AND contains(content, word)),
l2 AS (SELECT DISTINCT msg_id, 2 AS layer FROM few JOIN kw ON kw.layer = 2 AND contains(content, word) WHERE (SELECT count(*) FROM l1) < 5),
l3 AS (SELECT DISTINCT f.msg_id, 3 AS layer FROM few f JOIN abo ON abo.msg_id = f.msg_id AND topic IN (SELECT topic FROM hit)),
l4 AS (SELECT DISTINCT f.msg_id, 4 AS layer FROM few f JOIN men ON men.msg_id = f.msg_id AND entity IN (SELECT word FROM kw)),
u AS (SELECT msg_id, min(layer) AS layer FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4) GROUP BY msg_id)
SELECT msg_id, layer FROM u ORDER BY msg_id DESC LIMIT 15"""
)
def semantic_search(spark, d):
    c = conversation_messages(spark, d)
    words = topic_table(spark)
    return search.layered(c, words, ASK, edges.about(c, words.select("topic", F.col("word").alias("keyword"))), edges.mentions(c, entity_table(spark)), limit=15).select("msg_id", "layer")


@query(f"WITH {C_SQL}, {T_SQL}, s AS (SELECT topic, sum((length(content) - length(replace(content, word, ''))) // length(word))::BIGINT AS mention_score FROM c, t GROUP BY topic) SELECT topic, mention_score FROM s WHERE mention_score >= 3")
def topic_scores(spark, d):
    return entities.topic_scores(conversation_messages(spark, d), topic_table(spark).select("topic", F.col("word").alias("keyword")), 3)


@query(f"WITH {C_SQL}, k(event, keyword) AS (VALUES ('e1', 'ndble'), ('e2', 'shha'), ('e3', 'ment')) SELECT event, arg_min(source_file || ':' || turn, msg_id) AS first_mention, arg_max(source_file || ':' || turn, msg_id) AS last_mention, count(DISTINCT msg_id) AS messages FROM c JOIN k ON contains(content, keyword) GROUP BY event")
def event_spans(spark, d):
    k = spark.createDataFrame([("e1", "ndble"), ("e2", "shha"), ("e3", "ment")], "event string, keyword string")
    c = conversation_messages(spark, d).withColumn("formatted_time", F.concat_ws(":", "source_file", F.col("turn").cast("string")))
    return entities.event_spans(c, k)


@query(f"WITH {C_SQL} SELECT 'b' || (conv_id // 10) AS month, count(*) AS cnt, count(*) FILTER (contains(content, 'que')) AS sad FROM c WHERE contains(content, 'with') OR contains(content, 'que') GROUP BY month")
def topic_temporal(spark, d):
    c = conversation_messages(spark, d).withColumn("month", F.concat(F.lit("b"), F.expr("conv_id div 10").cast("string")))
    return search.topic_months(c, ("with", "que"), F.col("content").contains("que"))


@query(f"WITH {C_SQL}, m AS (SELECT sender, msg_id, substr(content, 1, 50) AS x FROM c WHERE contains(content, 'tion')) SELECT sender, count(*) AS n, string_agg(x, '|' ORDER BY msg_id) FILTER (k <= 3) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY msg_id) AS k FROM m) GROUP BY sender")
def mentions_by_speaker(spark, d):
    return search.mentions_by_speaker(conversation_messages(spark, d), "tion", 3).select("sender", "n", F.array_join("samples", "|").alias("samples"))


@query(
    f"""WITH {C_SQL} SELECT a.msg_id AS self_id, b.msg_id AS target_id FROM c a JOIN c b ON abs(a.msg_id - b.msg_id) < 10 AND a.msg_id <> b.msg_id
WHERE a.sender_role = 'self' AND b.sender_role = 'target' AND contains(a.content, 'was') AND contains(b.content, 'was')"""
)
def conversation_pairs(spark, d):
    return search.conversation_pairs(conversation_messages(spark, d), "was", 10, limit=None).select("self_id", "target_id")


@query(f"WITH {C_SQL}, x AS (SELECT unnest(regexp_extract_all(content, '([\\p{{L}}\\p{{N}}_]{{1,4}})tion', 0)) AS name FROM c) SELECT name, count(*) AS frequency FROM x GROUP BY name HAVING count(*) >= 3")
def title_entities(spark, d):
    return entities.titled(conversation_messages(spark, d), ("tion",), 3).select("name", "frequency")


@query(f"WITH {C_SQL}, {MEN_SQL} SELECT a.msg_id AS source_msg_id, a.entity AS from_, b.entity AS to_ FROM men a JOIN men b ON a.msg_id = b.msg_id AND a.entity < b.entity")
def co_occurs(spark, d):
    return entities.cooccurring_in_message(conversation_messages(spark, d), entity_table(spark))


@query(f"WITH {C_SQL}, {P_SQL} SELECT sender AS name, count(DISTINCT sender_role) AS roles, string_agg(DISTINCT sender_role, ',' ORDER BY sender_role) AS conflicting_roles FROM p GROUP BY sender HAVING count(DISTINCT sender_role) > 1")
def disambiguate(spark, d):
    return entities.role_conflicts(p_variant(spark, d).select(F.col("sender").alias("name"), F.col("sender_role").alias("role"))).select("name", "roles", F.array_join("conflicting_roles", ",").alias("conflicting_roles"))


@query(f"WITH {C_SQL}, n AS (SELECT unnest(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_]+')) AS name FROM c) SELECT name, count(*) AS frequency FROM n WHERE length(name) BETWEEN 2 AND 3 AND name NOT IN ('the', 'of') AND NOT contains(name, 'q') GROUP BY name HAVING count(*) >= 3 ORDER BY frequency DESC, name LIMIT 50")
def name_candidates(spark, d):
    return entities.name_candidates(conversation_messages(spark, d), stop=("the", "of"), forbidden=("q",), letters=r"\p{L}\p{N}_", top=50, least=3)


@query(f"WITH {C_SQL} SELECT sender, (k - 1) // 20 AS chunk, string_agg(content, chr(10) ORDER BY msg_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY msg_id) AS k FROM c) WHERE k <= 500 GROUP BY ALL")
def sample_text(spark, d):
    return samples.sample_text(conversation_messages(spark, d), "sender", 20, 25)


# ---- names at size: the messages' short words, spelt with a character for each letter, and as abbreviations

ALPHABET, HAN_LETTERS = "abcdefghijklmnopqrstuvwxyz", "阿波茨德额佛哥喝衣鸡科了摸呢哦坡器日思特屋迂乌西呀资"
NAME_TABLE = dict(zip(HAN_LETTERS, ALPHABET, strict=True))
NAME_ENDS, NAME_TITLES = ("额日", "衣呢", "特"), ("额日", "特")
TABLE_SQL = f"'{HAN_LETTERS}', '{ALPHABET}'"


def end_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({c}, '{s}') AND length({c}) > {len(s)} THEN substr({c}, 1, length({c}) - {len(s)})" for s in NAME_ENDS) + f" ELSE {c} END"


HAN_COUNT = r"length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'))"
SHORT_SQL = "(regexp_matches(lower({0}), '^[a-z]{{2,4}}$') AND length({1}) >= 2 AND length({0}) = length({1}) AND lower(translate({1}, " + TABLE_SQL + ")) = lower({0}))"
WORD_NAMES_SQL = f"""{C_SQL}, ws AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(content), '[^a-z]+')) AS w FROM c),
nm AS (SELECT translate(w, '{ALPHABET}', '{HAN_LETTERS}') AS name FROM ws WHERE length(w) BETWEEN 2 AND 4 UNION SELECT w FROM ws WHERE length(w) = 2),
nf AS (SELECT name, {end_sql('name')} AS n, {like_any('name', NAME_TITLES)} AS titled FROM nm),
np AS (SELECT a.name AS e1, b.name AS e2, a.n AS n1, b.n AS n2, a.titled AS t1, b.titled AS t2, CASE WHEN length(a.n) < length(b.n) THEN a.n ELSE b.n END AS shorter, greatest(length(a.n), length(b.n)) AS longest,
    {HAN_COUNT.format('a.n')} > 0 AND {HAN_COUNT.format('b.n')} > 0 AS han FROM nf a JOIN nf b ON a.name < b.name)
SELECT e1, e2, m.c::DOUBLE AS confidence, m.r AS reason FROM (SELECT e1, e2, CASE WHEN n1 = n2 THEN {{'c': 1.0, 'r': 'identical'}}
  WHEN (contains(n1, n2) OR contains(n2, n1)) AND {HAN_COUNT.format('shorter')} >= 2 AND longest <= 3 * length(shorter) THEN {{'c': 0.85, 'r': 'substring'}}
  WHEN han AND regexp_replace(n1, '[a-zA-Z]+$', '') = regexp_replace(n2, '[a-zA-Z]+$', '') THEN {{'c': 0.95, 'r': 'name+title'}}
  WHEN {SHORT_SQL.format('n1', 'n2')} THEN {{'c': 0.9, 'r': 'abbrev:' || n1 || '→' || n2}}
  WHEN {SHORT_SQL.format('n2', 'n1')} THEN {{'c': 0.9, 'r': 'abbrev:' || n2 || '→' || n1}}
  WHEN han AND substr(n1, 1, 1) = substr(n2, 1, 1) AND ((t1 AND length(n2) <= 3) OR (t2 AND length(n1) <= 3)) THEN {{'c': 0.7, 'r': 'surname+title'}} END AS m FROM np) WHERE m IS NOT NULL"""


def word_names(spark, d):
    w = conversation_messages(spark, d).select(F.explode(F.split(F.lower("content"), "[^a-z]+")).alias("w")).distinct()
    spelt = w.where(F.length("w").between(2, 4)).select(F.translate("w", ALPHABET, HAN_LETTERS).alias("name"))
    return spelt.union(w.where(F.length("w") == 2)).distinct()


@query(f"WITH {WORD_NAMES_SQL}")
def name_pairs(spark, d):
    return resolve.candidates(word_names(spark, d), NAME_TABLE, titles=NAME_TITLES, suffixes=NAME_ENDS)


@query(f"WITH {C_SQL} SELECT msg_id, 5 - 2 * bad AS style, bad AS issues FROM (SELECT msg_id, contains(content, 'tion')::INT + contains(content, 'the')::INT AS bad FROM c) WHERE bad > 0 AND 5 - 2 * bad >= 1")
def style_failures(spark, d):
    s = conversation_messages(spark, d).withColumn("s", rules.style_score(F.col("content"), rules.Style("tion", ("the",), (), "\x00"))).where(~F.col("s.passed"))
    return s.select("msg_id", F.col("s.style_score").alias("style"), F.size("s.issues").alias("issues"))


@query(f"WITH {C_SQL}, {MEN_SQL} SELECT m.msg_id, m.entity FROM men m JOIN c ON c.msg_id = m.msg_id WHERE c.sender_role = 'target'")
def annotated_mentions(spark, d):
    c = conversation_messages(spark, d).where("sender_role = 'target'").withColumn("context", F.lit("x"))
    return annotate.mentioned(annotate.ContextRules(NAMES, NEUTRAL, WARM, COLD).annotate(c))


RELEVANCE_SQL = f"""{CR_SQL}, fb AS (SELECT *, max(CASE WHEN sender_role = 'self' THEN msg_id END) OVER (PARTITION BY source_file ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM cr),
cx AS (SELECT f.msg_id, f.content, x.content AS context, trim(f.content) AS t FROM fb f LEFT JOIN cr r ON r.msg_id = f.reply_to AND r.sender_role = 'self' LEFT JOIN cr x ON x.msg_id = coalesce(r.msg_id, f.latest) WHERE f.sender_role = 'target'),
em AS (SELECT msg_id, coalesce(context, '') = '' AS alone, CASE WHEN {like_any("t", NEUTRAL)} AND NOT {like_any("t", WARM)} THEN 'neutral_ack' WHEN {like_any("t", WARM)} THEN 'warm_reply' WHEN length(t) <= 8 AND {like_any("t", COLD)} THEN 'cold_response' ELSE 'neutral' END AS emotion,
    len(list_intersect(list_transform(range(1, greatest(length(content) - 1, 1) + 1), lambda i: substr(content, i, 2)), list_transform(range(1, greatest(length(coalesce(context, '')) - 1, 1) + 1), lambda i: substr(coalesce(context, ''), i, 2)))) > 0 AS shares FROM cx)"""


@query(
    f"""WITH {RELEVANCE_SQL} SELECT msg_id, emotion, CASE WHEN alone THEN 'topic_opener' WHEN emotion = 'cold_response' THEN 'deflecting' WHEN emotion = 'neutral_ack' THEN 'ending' WHEN shares OR emotion = 'warm_reply' THEN 'response' ELSE 'standalone' END AS conversation_role,
  CASE WHEN alone THEN 'topic_shift' WHEN emotion = 'neutral_ack' THEN 'acknowledgment' WHEN emotion = 'cold_response' THEN 'deflecting' WHEN emotion = 'warm_reply' THEN 'emotional_response' WHEN shares THEN 'direct_answer' ELSE 'topic_shift' END AS context_relevance FROM em"""
)
def context_annotations(spark, d):
    rows = annotate.with_context(threaded(spark, d))
    return annotate.ContextRules(NAMES, NEUTRAL, WARM, COLD).annotate(rows).select("msg_id", "emotion", "conversation_role", "context_relevance")


# ---- the default fact rules, on texts that hold each of their patterns

DEFAULT_TEXTS = [(i, p.removeprefix("re:").replace(".*", "x")) for i, p in enumerate(p for r in lex.FACT_RULES for p in r[2])]


def rule_sql(words) -> str:
    return "(" + " OR ".join(f"regexp_matches(content, '{w[3:]}')" if w.startswith("re:") else f"contains(content, '{w}')" for w in words) + ")"


@query(
    "WITH m(i, content) AS (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in DEFAULT_TEXTS)
    + ") "
    + " UNION ALL ".join(f"SELECT i AS source_msg_id, '{c}' AS category, '{p}' AS predicate FROM m WHERE {rule_sql(pos)}" + (f" AND NOT {rule_sql(neg)}" if neg else "") for c, p, pos, neg in lex.FACT_RULES)
)
def default_facts(spark, d):
    m = spark.createDataFrame([(i, "p", "self", t) for i, t in DEFAULT_TEXTS], "msg_id int, sender string, sender_role string, content string")
    return facts.extract(m).select("source_msg_id", "category", "predicate")
