from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import documents, graph, relations, resolve, search
from colloquy.operators.components import components


def test_components_against_union_find(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7), (None, 1)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def clique(names):
    return [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]


def test_louvain_finds_cliques(spark):
    e = spark.createDataFrame(clique("abcde") + clique("fghij") + [("a", "f", 0.5)], "src string, dst string, weight double")
    got = graph.louvain(e)
    groups = {tuple(sorted(r.members)) for r in graph.communities(got).collect()}
    assert groups == {tuple("abcde"), tuple("fghij")}
    assert graph.modularity(e, got) > 0.4


def test_pagerank_sums(spark):
    e = spark.createDataFrame(clique("abc") + [("c", "d", 2.0)], "src string, dst string, weight double")
    got = {r.node: r.score for r in graph.pagerank(e).collect()}
    assert sum(got.values()) == pytest.approx(4 * (1 - 0.85**21)) and max(got, key=got.get) == "c"


def test_neighbor_jaccard(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "z"), ("a", "b")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "b"), ("x", "q")], "p1 string, p2 string")
    assert {(r.p1, r.p2): r.jaccard for r in graph.neighbor_jaccard(e, pairs).collect()} == {("a", "b"): 0.333333, ("x", "q"): 0.0}


def test_strength_and_kinds(spark):
    rows = spark.createDataFrame([(5318, 0, 0, 0), (3, 3, 0, 0), (1, 1, 0, 0), (1, 0, 0, 2), (1, 0, 0, 0)], "d int, g int, gm int, p int")
    got = rows.select(relations.strength(F.col("d"), F.col("gm")), relations.kind(F.col("d"), F.col("g"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(128.7, "close_private"), (20.8, "group_regular"), (10.4, "group_acquaintance"), (10.4, "light_private"), (10.4, "none")]


def test_names_with_a_common_surname_meet_by_title_only(spark):
    names = spark.createDataFrame([(f"王{chr(0x4E00 + 97 * i)}{chr(0x5E00 + 89 * i)}",) for i in range(40)] + [("王老师",), ("wxm",), ("王小明",), ("小明",), ("王小明老师",), ("李",), ("李Ocean",), ("李A",), ("Ann",), ("ANN",), ("An",)], "name string")
    rows = [r.name for r in names.collect()]
    every = spark.createDataFrame([(a, b) for a in rows for b in rows if a < b], "e1 string, e2 string")
    tab = dict(resolve.lex.INITIALS) | {"小": "x", "明": "m"}
    want = {tuple(r) for r in resolve.rule_match(every, table=tab).collect()}
    got = [tuple(r) for r in resolve.candidates(names, tab).collect()]
    assert set(got) == want and len(got) == len(want) and {("王小明", "王老师", 0.7, "surname+title"), ("李", "李Ocean", 0.95, "name+title"), ("李A", "李Ocean", 0.95, "name+title")} <= want


def test_band_join_has_no_product(spark, capsys):
    ids = spark.range(1000).withColumnRenamed("id", "a")
    got = search.banded(ids, ids.withColumnRenamed("a", "b"), 5, "a", "b")
    assert got.count() == 7980
    got.explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_llm_confirmation(spark):
    found = spark.createDataFrame([("a", "b", 1.0, "identical"), ("c", "d", 0.9, "abbrev"), ("e", "f", 0.7, "surname+title")], "e1 string, e2 string, confidence double, reason string")
    structure = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.6), ("e", "f", 0.5)], "p1 string, p2 string, jaccard double")
    assert {r.e1 for r in resolve.confirmed(found, structure).collect()} == {"a", "c", "e"}
    said = lambda rows: rows.select("e1", "e2", F.lit(True).alias("same"), F.lit(0.7).alias("llm_confidence"))
    got = {r.e1: r.confidence for r in resolve.confirmed(found, structure, confirm=said).collect()}
    assert set(got) == {"a", "c"} and got["c"] == pytest.approx((0.81 + 0.7) / 2)


def test_smart_routes(spark):
    m = spark.createDataFrame([(i, "2024-01", "self" if i % 2 else "target", f"p{i % 2}", "ann went by boat" if i % 3 else "nothing") for i in range(1, 20)], "msg_id bigint, month string, sender_role string, sender string, content string")
    topics = spark.createDataFrame([("sea", "boat"), ("work", "office")], "topic string, word string")
    people = spark.createDataFrame([("person", "ann", [])], "type string, name string, aliases array<string>")
    about = m.where("content like '%boat%'").select("msg_id", F.lit("sea").alias("topic"))
    men = m.where("content like '%ann%'").select("msg_id", F.lit("ann").alias("entity"))
    out = search.smart(m, topics, people, about, men, "ann boat 最近")
    assert set(out) == {"entities", "context", "related", "speakers", "pairs", "temporal"}
    assert out["context"].count() == 13 and out["temporal"].first().cnt == 13
    assert "temporal" not in search.smart(m, topics, people, about, men, "office")
    assert [r.word for r in search.expand(topics, "no such").collect()] == ["no such"]


def test_personas(spark):
    men = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "msg_id bigint, entity string")
    roles = spark.createDataFrame([(1, "target"), (2, "self")], "msg_id bigint, role string")
    about = spark.createDataFrame([(1, "t")], "msg_id bigint, topic string")
    text = documents.personas(graph.person_context(men, roles, about)).where("entity = 'a'").first().text
    assert text.startswith("# a") and "- b (2)" in text and "- t (1)" in text
