from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from colloquy.functions import rules
from colloquy.operators import annotate, evaluate, facts, sessions
from colloquy.streaming import session_stream

TEXTS = [("哦", "cold_response", 0.8, True), ("嗯嗯好的", "neutral_ack", 0.2, False), ("哈哈 笑死", "warm_reply", 0.5, False), ("随便你怎么想", "cold_response", 0.5, True), ("随便你怎么想吧我不管了", "neutral", 0.0, False), ("", "neutral", 0.0, False), ("今天下雨", "neutral", 0.0, False)]


def test_emotion_ladder(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "i int, t string").withColumn("c", rules.classify(F.col("t")))
    assert [tuple(r.c) for r in df.orderBy("i").collect()] == [t[1:] for t in TEXTS]


def test_override_only_raises_cold(spark):
    df = spark.createDataFrame([("哈哈", "angry", True), ("哦", "joking", False), ("雨", None, None)], "t string, e string, c boolean")
    got = [tuple(r[0]) for r in df.select(rules.with_override(rules.classify(F.col("t")), F.col("e"), F.col("c"))).collect()]
    assert got == [("angry", 0.5, True), ("cold_response", 0.8, True), ("neutral", 0.0, False)]


def test_facts_negatives_regex_and_object(spark):
    m = spark.createDataFrame([(1, "a", "self", "我爱吃面，你呢？"), (2, "a", "self", "我不爱吃面"), (3, "b", "target", "我喜欢晚上吃面"), (4, "b", "system", "爱吃"), (5, "b", "target", "")], "msg_id bigint, sender string, sender_role string, content string")
    got = facts.extract(m)
    assert sorted((r.source_msg_id, r.predicate) for r in got.where("category = 'preference'").collect()) == [(1, "喜欢吃"), (2, "不喜欢吃"), (3, "喜欢吃")]
    assert got.where("source_msg_id = 1 and predicate = '喜欢吃'").first().object == "我爱吃面，你呢"
    ids = [r.fact_id for r in facts.numbered(got).collect()]
    assert len(set(ids)) == len(ids)


def test_fold_clamps(spark):
    turns = spark.createDataFrame([("s", i, -0.5, f"t{i}") for i in range(4)] + [("s", 9, 0.3, "end")], "session string, turn bigint, delta double, text string")
    last = sessions.fold(turns, "session").first()
    assert last.mood == pytest.approx(-0.7) and last.turn_count == 5 and last.last_topic == "end"
    path = sessions.trajectory(turns, "session").orderBy("k").collect()
    assert [round(r.mood, 6) for r in path] == [-0.5, -1.0, -1.0, -1.0, -0.7] and path[-1].intimacy == pytest.approx(last.intimacy)
    asked = spark.createDataFrame([("s",), ("new",)], "session string")
    fresh = {r.session: r for r in sessions.status(sessions.fold(turns, "session"), asked, "session").collect()}["new"]
    assert (fresh.mood, fresh.intimacy, fresh.turn_count, fresh.last_topic) == (0.0, 0.5, 0, "")


def test_stream_equals_batch(spark, tmp_path):
    schema = "session string, turn bigint, reply string, text string, reset boolean"
    rows = [("s", 1, "哦", "one", False), ("s", 2, "哈哈", "two", False), ("t", 1, "哈哈", "x", False), ("t", 2, None, None, True), ("s", 3, "随便你怎么想", "three", False)]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "tmp" / str(i)))
        source = next((tmp_path / "tmp" / str(i)).glob("part-*.json"))
        source.rename(tmp_path / "in" / f"{i}.json")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = session_stream.session_updates(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.session: r for r in spark.sql("select session, max_by(mood, turn_count) mood, max(turn_count) n, max_by(last_topic, turn_count) topic from states group by session").collect()}
    assert got["s"].n == 3 and got["s"].mood == pytest.approx(-0.2 + 0.075 - 0.125) and got["s"].topic == "three"
    assert got["t"].n == 0


def test_annotators(spark):
    m = spark.createDataFrame([(i, "哈哈" if i % 2 else "a much longer text", "target") for i in range(7)], "msg_id bigint, content string, sender_role string")
    calls = annotate.RemoteAnnotator(lambda texts: [{"emotion": "sad", "intensity": 0.4}] * (len(texts) - 1), batch=3)
    got = annotate.hybrid(m, annotate.RuleAnnotator(), calls)
    assert got.count() == 7 and {r.emotion for r in got.where("annotator = 'rules'").collect()} == {"warm_reply"}
    assert got.where("emotion = 'neutral'").count() >= 1  # what the client left out
    assert annotate.pending(m, got.where("msg_id < 5").select("msg_id")).count() == 2
    old = got.withColumn("emotion", F.lit("old")).drop("annotator")
    assert annotate.written_back(old, got.where("msg_id = 1").drop("annotator")).where("emotion = 'old'").count() == 6


def test_context_scopes(spark):
    m = spark.createDataFrame([(1, "a", "self", "A", None), (2, "b", "target", "B", None), (3, "b", "self", "C", 2), (4, "b", "target", "D", 3), (5, "b", "target", "E", 4)], "msg_id bigint, source_file string, sender_role string, content string, reply_to bigint")
    chat = {r.msg_id: r.context for r in annotate.with_context(m).collect()}
    assert chat == {2: None, 4: "C", 5: "C"}
    assert {r.msg_id: r.context for r in annotate.with_context(m, "global").collect()}[2] == "A"


def test_global_context_over_bands(spark):
    rows = [(i, f"c{i % 3}", "self" if i % 7 == 2 else "target", f"t{i}", None) for i in range(1, 60)]
    m = spark.createDataFrame(rows, "msg_id bigint, source_file string, sender_role string, content string, reply_to bigint")
    got = {r.msg_id: r.context for r in annotate.with_context(m, "global", width=5).collect()}
    want, last = {}, None
    for i, _, role, text, _ in rows:
        if role == "target":
            want[i] = last
        else:
            last = text
    assert got == want


def test_annotations_with_context(spark):
    m = spark.createDataFrame([(1, "晚上吃面吗", None), (2, "哦", "晚上吃面吗"), (3, "吃面", "晚上吃面吗"), (4, "收到", "开会"), (5, "哈哈 Ann", "x"), (6, "明天下雨了吧大概是的", "x")], "msg_id bigint, content string, context string")
    got = {r.msg_id: r for r in annotate.ContextRules(("Ann", "B")).annotate(m).collect()}
    assert {k: r.context_relevance for k, r in got.items()} == {1: "topic_shift", 2: "deflecting", 3: "direct_answer", 4: "acknowledgment", 5: "emotional_response", 6: "topic_shift"}
    assert {k: r.conversation_role for k, r in got.items()} == {1: "topic_opener", 2: "deflecting", 3: "response", 4: "ending", 5: "response", 6: "standalone"}
    assert [(r.msg_id, r.entity) for r in annotate.mentioned(annotate.ContextRules(("Ann", "B")).annotate(m)).collect()] == [(5, "Ann")]

    def client(pairs):
        return [{"emotion": "cold_response", "intensity": "much", "persons": ["Ann", "x", 3], "context_relevance": c and "direct_answer"} for c, _ in pairs]

    said = {r.msg_id: r for r in annotate.RemoteAnnotator(client, contextual=True).annotate(m).collect()}
    assert said[1].context_relevance == "unknown" and said[2].context_relevance == "direct_answer" and said[2].cold_signal and said[2].intensity == 0.0 and said[2].persons == ["Ann"]

    def broken(texts):
        raise OSError("away")

    assert {r.emotion for r in annotate.RemoteAnnotator(broken, tries=2, pause=0.01).annotate(m).collect()} == {"neutral"}


def test_default_rules_are_whole(spark):
    texts = [(i, "a", "self", p.removeprefix("re:").replace(".*", "x")) for i, p in enumerate(p for r in facts.lex.FACT_RULES for p in r[2])]
    owners = [(r[0], r[1]) for r in facts.lex.FACT_RULES for _ in r[2]]
    forbidden = [any(n in t[3] for n in r[3]) for t, r in zip(texts, (r for r in facts.lex.FACT_RULES for _ in r[2]), strict=True)]
    found = {(r.source_msg_id, r.category, r.predicate) for r in facts.extract(spark.createDataFrame(texts, "msg_id bigint, sender string, sender_role string, content string")).collect()}
    assert len(texts) == 116
    for (i, *_), owner, no in zip(texts, owners, forbidden, strict=True):
        assert ((i, *owner) in found) != no
    ids = sorted(r.fact_id for r in facts.numbered(facts.extract(spark.createDataFrame(texts, "msg_id bigint, sender string, sender_role string, content string")), width=10).collect())
    assert ids[0] == "F_00001" and ids == [f"F_{i:05d}" for i in range(1, len(ids) + 1)]


def test_short_replies(spark):
    rows = spark.createDataFrame([("",), ("ok",), ("a bit longer",), ("this one is somewhat longer",), ("x" * 40,), ("[x] hi",), ("[旺柴]",)], "t string")
    got = [(r.s.length, r.s.style, r.s.emoji) for r in rows.select(rules.reply_score(F.col("t")).alias("s")).collect()]
    assert got == [(0, 100, 95), (90, 100, 95), (70, 100, 95), (50, 100, 95), (20, 100, 95), (90, 100, 65), (90, 60, 0)]


def test_kappa_edges(spark):
    same = spark.createDataFrame([(i, r, 1) for i in range(4) for r in ("a", "b")], "item int, rater string, label int")
    assert evaluate.pairwise_kappa(same).first().kappa == 1.0
    cross = spark.createDataFrame([(i, r, (i + (r == "b")) % 2) for i in range(4) for r in ("a", "b")], "item int, rater string, label int")
    assert evaluate.pairwise_kappa(cross).first().kappa == -1.0
