from __future__ import annotations

import json

from pyspark.sql import functions as F

from colloquy.functions import rules
from colloquy.operators import annotate, documents, entities, evaluate, graph, search, temporal
from colloquy.plans import reports
from colloquy.sources import sinks


def test_extract_entities(spark):
    m = spark.createDataFrame([(1, "t1", "王老师 and Ann at sea"), (2, "t2", "Ann, Bob by the sea sea"), (3, "t3", "office party")], "msg_id bigint, formatted_time string, content string")
    names = spark.createDataFrame([("Ann",), ("Bob",)], "name string")
    topics = spark.createDataFrame([("sea", "sea"), ("work", "office")], "topic string, keyword string")
    events = spark.createDataFrame([("party", "party"), ("trip", "sea")], "event string, keyword string")
    out = entities.extract_entities(m, names, ("老师",), topics, events)
    assert {r.name for r in out["persons"].collect()} == {"Ann", "Bob", "王老师"}
    assert sorted(r.entity_id for r in out["persons"].collect()) == ["person_1", "person_2", "person_3"]
    me = spark.createDataFrame([("Ann",), ("王老师",)], "name string")
    assert [r.name for r in entities.extract_entities(m, names, ("老师",), topics, events, me)["persons"].collect()] == ["Bob"]
    assert entities.excluded(spark.createDataFrame([("同学",), ("Ann",)], "name string")).first().name == "Ann"
    assert [(r.topic, r.mention_score) for r in out["topics"].collect()] == [("sea", 3)]
    assert {(r.event, r.first_mention, r.last_mention) for r in out["events"].collect()} == {("party", "t3", "t3"), ("trip", "t1", "t2")}
    assert [(r.source_msg_id, r.from_, r.to_) for r in out["relations"].collect()] == [(2, "Ann", "Bob")]


def test_social_identity(spark):
    m = spark.createDataFrame([(i, "ann") for i in range(8)], "msg_id bigint, sender string")
    rel = spark.createDataFrame([("ann", "bob", 3.0)], "p1 string, p2 string, interaction_strength double")
    shared = spark.createDataFrame([("ann", "bob", "g", 2, 3)], "p1 string, p2 string, source_file string, n1 bigint, n2 bigint")
    same = spark.createDataFrame([("ann", "Ann B"), ("annie", "Ann B"), ("x", "X")], "member string, identity string")
    out = search.social_context(m, rel, shared, same, "ann")
    assert [r.msg_id for r in out["last_messages"].collect()] == [7, 6, 5, 4, 3]
    assert out["identity"].first().members == ["ann", "annie"]


def test_cleanup_and_grades(spark):
    t = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("json {}",), (" plain ",)], "t string")
    assert [r[0] for r in t.select(rules.strip_fence(F.col("t"))).collect()] == ['{"a": 1}', "{}", "plain"]
    k = spark.createDataFrame([(0.9,), (0.75,), (0.5,), (0.1,)], "k double")
    assert [r[0] for r in k.select(evaluate.kappa_grade(F.col("k"))).collect()] == ["excellent", "good", "moderate", "poor"]
    assert rules.reply_score(F.lit("hi"), None) is not None


def test_append_and_distribution(spark, tmp_path):
    run = spark.createDataFrame([(1, 0.5)], "run int, score double")
    for _ in range(2):
        sinks.write_json(run, str(tmp_path / "h"), append=True)
    assert spark.read.json(str(tmp_path / "h")).count() == 2
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "emotion string")
    assert {(r.value, r.n) for r in annotate.distribution(a).collect()} == {("x", 2), ("y", 1)}
    assert annotate.progress(20, 100, 10.0) == {"done": 20, "total": 100, "rate": 2.0, "share": 0.2, "left": 40.0}


def test_documents(spark):
    f = spark.createDataFrame([(i, "preference", "likes", f"tea number {i}", i, 0.9, "p") for i in range(30)], "rule int, category string, predicate string, object string, source_msg_id bigint, confidence double, subject string")
    text = documents.memories(f, "m").first().text
    assert text.count("**likes**") == 20 and "[msg#1" in text and "## 3." in text
    assert documents.skill("s", 3, ["a"]).startswith("# s")
    felt = spark.createDataFrame([(1, "emotion", "开心", "so glad", 4, 0.9, "p"), (2, "self_perception", "自我描述", "I am slow", 5, 0.9, "p")], f.schema)
    page = documents.persona(felt, "p").first().text
    assert "## 1. Gladness (1 facts)" in page and "so glad\n  [confidence 90%, msg#4]" in page and "I am slow" in page and "## 2. Sadness and worry (0 facts)" in page
    assert documents.meta("p", "p", 2, "2024-01-01", tags={"a": 1})["total_source_facts"] == 2


def test_written_documents(spark, tmp_path):
    men = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "a b"), (2, "c")], "msg_id bigint, entity string")
    contexts = graph.person_context(men, men.selectExpr("msg_id", "'self' as role").distinct(), men.selectExpr("msg_id", "'t' as topic"))
    documents.write_personas(contexts, str(tmp_path / "p"))
    assert (tmp_path / "p" / "pages" / "slug=a_b").is_dir()
    got = {r.name: r for r in spark.read.json(str(tmp_path / "p" / "_summary")).collect()}
    assert got["a b"].top_topics == ["t"] and got["c"].top_co_occurring == ["a b"] and got["c"].mentions == 2
    facts = spark.createDataFrame([(1, "emotion", "开心", "so glad", 4, 0.9, "p")], "rule int, category string, predicate string, object string, source_msg_id bigint, confidence double, subject string")
    documents.write_documents(spark, facts, "p", "p", str(tmp_path / "d"), "2024-01-01", profile={"x": "y"})
    meta = json.loads(spark.read.text(str(tmp_path / "d" / "meta")).first().value)
    assert meta["profile"] == {"x": "y"} and meta["version"] == "v1-verified"


def test_reports(spark):
    rows = [(i, "晚上吃什么", "吃面" if i % 2 else "哦", "吃饭" if i % 3 else "嗯") for i in range(12)]
    got = reports.evaluation(spark.createDataFrame(rows, "id bigint, context string, reply string, real string")).first()
    assert got.n == 12 and got.style.score == 100.0 and got.emotion.cold_signal_accuracy == 0.5 and got.coherence.score == 100.0
    assert abs(got.composite_score - (got.style.score + got.length.score + got.emotion.score + got.coherence.score + got.relevance.score) / 5) < 0.06
    assert reports.evaluation(spark.createDataFrame([], "id bigint, context string, reply string, real string")).count() == 0
    scores = spark.createDataFrame([(True, True, 80.0), (True, False, 60.0), (False, True, 50.0), (False, False, 40.0)], "a boolean, b boolean, score double")
    assert {(r.factor, r.avg_on, r.avg_off, r.contribution, r.full_score) for r in reports.ablation(scores, ["a", "b"]).collect()} == {("a", 70.0, 45.0, 25.0, 80.0), ("b", 65.0, 50.0, 15.0, 80.0)}
    said = spark.createDataFrame([(i, r, d, "x" if i % 4 or r == "r1" else "y") for i in range(8) for r in ("r1", "r2", "r3") for d in ("emotion", "role")], "item bigint, rater string, dimension string, label string")
    one = reports.reliability(said).where("dimension = 'role'").first()
    assert (one.n, one.inconsistent_count, one.inconsistent_rate, list(one.inconsistent_samples)) == (8, 2, 0.25, [0, 4]) and len(one.pairs) == 3 and one.grade == "poor"


def test_timeline_map_and_empty_graph(spark):
    rows = spark.createDataFrame([("a", "2024-01"), ("a", "2024-01"), ("a", "2024-02")], "person string, month string")
    assert temporal.timeline_export(rows).first().months == {"2024-01": 2, "2024-02": 1}
    none = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.louvain(none).count() == 0 and graph.pagerank(none).count() == 0 and graph.modularity(none, spark.createDataFrame([], "node string, community string")) == 0.0
    network = sinks.network_json(spark.createDataFrame([("a", "self")], "name string, role string"), spark.createDataFrame([], "p1 string, p2 string, interaction_strength double, relationship_type string"))
    assert json.loads("".join(r.line for r in network.orderBy("part", "key").collect())) == {"nodes": [{"id": "a", "role": "self"}], "edges": []}
