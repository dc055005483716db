"""Whole conversations through routing, session state and style checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.functions import rules
from colloquy.operators import edges, search, sessions

#: Questions of a chat, the routes that they take beside the search, with invented names.
QUESTIONS = (
    ("在干嘛", set()), ("林小舟最近怎么样", {"related", "speakers", "pairs", "temporal"}), ("你喜欢吃什么", set()), ("视频组有图传吗", set()), ("周末去哪里玩", set()),
    ("韩一鸣在吗", {"related", "speakers", "pairs"}), ("你体育课怎么样", set()), ("方老师说了什么", {"related", "speakers", "pairs"}), ("你的劳务费发了吗", set()), ("你觉得爱情是什么", set()),
    ("林小舟现在干嘛", {"related", "speakers", "pairs", "temporal"}), ("你高中在哪里上的", set()), ("哦", set()), ("嗯", set()), ("哈哈哈哈", set()),
    ("你舍友怎么样", set()), ("那个视频拍完了吗", set()), ("韩一鸣靠谱吗", {"related", "speakers", "pairs"}), ("你姐姐怎么样", set()), ("太神了", set()),
)

#: What is asked, the reply, and whether it is cold, passes the style check.
TURNS = (
    ("在干嘛", "没干嘛 刷手机 [捂脸]", False, True), ("小舟呢", "又找我要视频", False, True), ("哦", "哦", True, True), ("周末去哪", "没想好去哪 [捂脸]", False, True), ("嗯", "嗯", True, True),
    ("体育课怎么样", "惨绝人寰", False, True), ("知道了", "哦哦 知道了", False, True), ("哈哈哈哈", "笑死 你又搞什么 [捂脸]", False, True), ("视频组十一人", "十一个人有图传 比我们强多了", False, False), ("太神了", "牛逼 [旺柴] 太好看了", False, False),
)


@pytest.fixture(scope="module")
def graph(spark):
    texts = ["林小舟的视频拍完了", "韩一鸣在图书馆", "方老师说论文要改", "林小舟和韩一鸣去吃面", "视频组开会", "哈哈"]
    m = spark.createDataFrame([(i + 1, "2024-01", "self" if i % 2 else "target", "p", t) for i, t in enumerate(texts)], "msg_id bigint, month string, sender_role string, sender string, content string").cache()
    topics = spark.createDataFrame([("video", "视频"), ("study", "论文")], "topic string, word string")
    people = spark.createDataFrame([("person", n, []) for n in ("林小舟", "韩一鸣", "方老师")], "type string, name string, aliases array<string>")
    return m, topics, people, edges.about(m, topics.withColumnRenamed("word", "keyword")).cache(), edges.mentions(m, people.select(F.col("name").alias("entity"))).cache()


def test_routes_of_twenty_questions(graph):
    m, topics, people, about, mentions = graph
    for asked, wanted in QUESTIONS:
        out = search.smart(m, topics, people, about, mentions, asked)
        assert set(out) - {"entities", "context"} == wanted, asked
        if "related" in wanted:
            assert out["speakers"].count() == 1


def test_search_by_topic(graph):
    m, topics, people, about, mentions = graph
    found = search.smart(m, topics, people, about, mentions, "视频组有图传吗")["context"].collect()
    assert [(r.msg_id, r.layer) for r in found] == [(5, 1), (1, 1)]


def test_ten_turns(spark):
    rows = spark.createDataFrame([(i, said, reply) for i, (said, reply, _, _) in enumerate(TURNS, 1)], "turn bigint, said string, reply string")
    style = rules.Style(others=("有图传",))
    checked = rows.withColumn("c", rules.classify(F.col("reply"))).withColumn("s", rules.style_score(F.col("reply"), style)).orderBy("turn").collect()
    assert [(r.c.cold_signal, r.s.passed) for r in checked] == [t[2:] for t in TURNS]
    assert [r.turn for r in checked if not r.s.passed] == [9, 10]
    delta = rules.mood_delta(F.col("c.emotion"), F.col("c.intensity"), F.col("c.cold_signal"))
    turns = rows.withColumn("c", rules.classify(F.col("reply"))).select(F.lit("s").alias("session"), "turn", delta.alias("delta"), F.col("said").alias("text"))
    path = [r.mood for r in sessions.trajectory(turns, "session").orderBy("k").collect()]
    assert path[2] < path[1] and path[4] < path[3] and path[7] > path[6]
    last = sessions.fold(turns, "session").first()
    assert last.turn_count == 10 and last.mood == pytest.approx(path[-1]) and last.last_topic == "太神了"
    fixed = spark.createDataFrame([("牛逼 [旺柴] 太好看了",)], "t string").withColumn("s", rules.style_score(F.col("t"))).select(rules.auto_fix(F.col("t"), F.col("s.issues"))).first()[0]
    assert "[旺柴]" not in fixed
