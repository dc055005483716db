from __future__ import annotations

import json

from pyspark.sql import functions as F

from colloquy.operators import edges, graph, threads
from colloquy.sources import readers, sinks


def export(folder, name, session, messages):
    (folder / name).write_text(json.dumps({"session": session, "messages": messages}, ensure_ascii=False), encoding="utf-8")


def raw(i, content, send, name=None, kind="text", at=1_700_000_000):
    return {"localId": i, "type": kind, "content": content, "isSend": send, "senderDisplayName": name, "createTime": at + i if at else 0, "formattedTime": f"2024-01-0{i}"}


def test_session_files_to_messages(spark, tmp_path):
    export(tmp_path, "b.json", {"wxid": "wxid_1", "displayName": "Peer", "memberCount": 0, "participants": []}, [raw(1, "hi", 0), raw(2, "hello", 1), raw(3, "", 1), raw(4, "note", 0, kind="system"), raw(5, "again", 0)])
    export(tmp_path, "a.json", {"wxid": "room", "displayName": "Room", "memberCount": 3, "participants": ["x"]}, [raw(1, "one", 0, " Ann\n"), raw(2, "two", 0, "Bob"), raw(3, "three", 0, "Bob"), raw(4, "four", 1, at=0)])
    (tmp_path / "broken.json").write_text("{not json")
    got = {(r.source_file, r.msg_id): r for r in readers.session_messages(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("a.json", 1), ("a.json", 2), ("a.json", 3), ("a.json", 4), ("b.json", 1), ("b.json", 2), ("b.json", 5)]
    assert (got["a.json", 1].sender, got["a.json", 1].sender_role, got["a.json", 1].reply_to) == ("Ann", "group_member", None)
    assert got["a.json", 2].reply_to == 1 and got["a.json", 3].reply_to is None and got["a.json", 4].reply_to == 3
    assert got["a.json", 4].timestamp == "" and got["b.json", 1].timestamp == "2023-11-14T22:13:21+00:00"
    assert (got["b.json", 1].sender, got["b.json", 2].sender, got["b.json", 2].reply_to) == ("Peer", "self", 1)
    assert got["b.json", 5].reply_to == 4  # a system message that the filter drops


def test_renumbered_maps_replies(spark):
    rows = spark.createDataFrame([("b", 1, None), ("b", 2, 1), ("a", 1, None), ("a", 2, 1)], "source_file string, msg_id bigint, reply_to bigint")
    got = sorted((r.source_file, r.msg_id, r.reply_to) for r in threads.renumbered(rows, "msg_id").collect())
    assert got == [("a", 1, None), ("a", 2, 1), ("b", 3, None), ("b", 4, 3)]


def test_substring_join_equals_list(spark):
    m = spark.createDataFrame([(1, "the sea and the seal"), (2, ""), (3, None), (4, "日本海")], "msg_id bigint, content string")
    names = spark.createDataFrame([("sea",), ("seal",), ("e",), ("",), ("海",)], "entity string")
    key = lambda df: sorted((r.msg_id, r.entity) for r in df.select("msg_id", "entity").distinct().collect())
    expected = [(1, "e"), (1, "sea"), (1, "seal"), (4, "海")]
    assert key(edges.containing(m, names, "entity")) == expected
    assert key(edges.containing_join(m, names.where("entity <> ''").distinct(), "entity")) == expected


def test_upsert_duplicates_and_roles(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, at int, v string")
    assert sorted((r.name, r.v) for r in edges.upsert(rows, ["name"], "at").collect()) == [("a", "y"), ("b", "z")]
    assert [r.name for r in edges.duplicates(rows, "name").collect()] == ["a"]
    m = spark.createDataFrame([("p", "self"), ("p", "target"), ("q", None), ("", "self"), (None, "self")], "sender string, sender_role string")
    assert sorted((r.name, r.role) for r in edges.persons(m).collect()) == [("p", "target"), ("q", "unknown")]


def test_dangling_replies_and_zero_counts(spark):
    m = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "a", 99)], "msg_id bigint, sender string, reply_to bigint")
    assert [(r.src, r.dst) for r in edges.reply_edges(m).collect()] == [(2, 1)]
    people = spark.createDataFrame([("a",), ("c",)], "name string")
    assert {(r.name, r.msg_count) for r in graph.message_counts(people, m).collect()} == {("a", 2), ("c", 0)}
    assert [r.display for r in spark.createDataFrame([("群聊_abc.json",)], "c string").select(threads.display_name(F.col("c"), ("群聊_",)).alias("display")).collect()] == ["abc"]


def test_graph_file_and_script(spark, tmp_path):
    nodes = spark.createDataFrame([("a&b", "self", 2), ("c", "target", 1)], "name string, role string, msg_count bigint")
    pairs = spark.createDataFrame([("a&b", "c", 3.5, "none", 0.0)], "p1 string, p2 string, interaction_strength double, relationship_type string, warmth double")
    sinks.write_lines(sinks.gexf(nodes, pairs), str(tmp_path / "g"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    import xml.etree.ElementTree as ET

    ns = "{http://www.gexf.net/1.3}"
    root = ET.fromstring("\n".join(open(p).read() for p in sorted((tmp_path / "g").glob("part-*"))))
    assert len(root.findall(f".//{ns}node")) == 2 and root.find(f".//{ns}edge").get("source") == "a&b" and "a&amp;b" in text
    m = spark.createDataFrame([(1, 'say "hi"\n', "c", None), (2, "x", "a&b", 1)], "msg_id bigint, content string, sender string, reply_to bigint")
    lines = [r.line for r in sinks.cypher(m, nodes).orderBy("part", "key").collect()]
    assert 'content: "say \\"hi\\"\\n"' in "".join(lines) and sum("REPLY_TO" in x for x in lines) == 1
    network = json.loads("".join(r.line for r in sinks.network_json(nodes, pairs).orderBy("part", "key").collect()))
    assert len(network["nodes"]) == 2 and network["edges"][0]["weight"] == 3.5


def test_readers_of_lines_facts_documents(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"msg_id": 1, "sender": "a"}\n\n{"msg_id": 2}\n')
    assert readers.message_lines(spark, str(tmp_path / "m.jsonl")).where(F.col("msg_id").isNotNull()).count() == 2
    (tmp_path / "f.json").write_text(json.dumps({"target": "t", "facts": [{"fact_id": "F_1", "object": "o"}]}))
    assert readers.fact_file(spark, str(tmp_path / "f.json")).first().fact_id == "F_1"
    (tmp_path / "d.md").write_text("# a\n\nb\n")
    assert readers.documents(spark, str(tmp_path / "d.md")).first().text == "# a\n\nb\n"
