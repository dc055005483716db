from __future__ import annotations

import datetime as dt
import json
import math
import os

from colloquy import __main__ as command
from colloquy.operators import relations, samples, temporal
from colloquy.plans import build
from colloquy.streaming import session_stream


def test_build_from_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    said = ["我爱吃面", "赵老师来了", "哈哈 赵老师和张老师", "张老师和赵老师都在", "嗯", "论文答辩"]
    for chat in ("a", "b"):
        messages = [{"localId": i + 1, "type": "text", "content": t, "isSend": i % 2, "senderDisplayName": None, "createTime": 1_700_000_000 + i, "formattedTime": "2024-01-01"} for i, t in enumerate(said)]
        (tmp_path / "in" / f"private_{chat}.json").write_text(json.dumps({"session": {"wxid": "wxid_1", "displayName": "Peer"}, "messages": messages}), encoding="utf-8")
    tables = build.build(spark, str(tmp_path / "in"), build.Config(topics=(("study", "论文"),)))
    build.write(tables, str(tmp_path / "out"))
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert sorted(r.msg_id for r in read("messages").collect()) == list(range(1, 13))
    assert {(r.name, r.role) for r in read("persons").collect()} == {("Peer", "target"), ("self", "self")}
    assert read("said").count() == 12 and read("reply_to").count() == 10
    assert read("relationships").first().direct_replies == 10
    assert read("about").count() == 2 and read("facts").where("predicate = '喜欢吃'").count() == 2
    assert {(r.p1, r.p2) for r in read("knows").collect()} >= {("张老师", "赵老师")}
    assert read("annotations").where("emotion = 'warm_reply'").count() == 2


def test_groups_are_known_by_their_type_not_their_name(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def write(name, session, said):
        messages = [{"localId": i + 1, "type": "text", "content": f"text {i}", "isSend": 0, "senderDisplayName": who, "createTime": 1_700_000_000 + i, "formattedTime": "2024-01-01"} for i, who in enumerate(said)]
        (folder / name).write_text(json.dumps({"session": session, "messages": messages}), encoding="utf-8")

    for g in range(3):
        write(f"群聊_g{g}.json", {"wxid": "room", "displayName": f"g{g}", "memberCount": 2}, ["Ann", "Bob"] * 3)
    write("私聊_x.json", {"wxid": "wxid_7", "displayName": "Ann"}, ["Ann", "Ann"])
    tables = build.build(spark, str(folder))
    got = tables["relationships"].collect()
    assert [(r.p1, r.p2, r.direct_replies, r.shared_groups, r.group_messages, r.private_messages) for r in got] == [("Ann", "Bob", 15, 3, 18, 0)]
    assert got[0].relationship_type == "group_regular" and got[0].interaction_strength == round(15 * math.log(16) + 5 * math.log(19), 1)
    m = tables["messages"]
    shared = relations.shared_groups(m, relations.interaction_pairs(m)).collect()
    assert sorted((r.source_file, r.n1, r.n2) for r in shared) == [(f"群聊_g{g}.json", 3, 3) for g in range(3)]
    trend = temporal.group_trend(m.selectExpr("*", "substring(formatted_time, 1, 7) as month"), "month", prefixes=("群聊_",))
    assert sorted((r.display, r.cnt) for r in trend.collect()) == [(f"g{g}", 6) for g in range(3)]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    said = [("我爱吃面", 0), ("哈哈", 1), ("我很喜欢这张", 0), ("赵老师", 1)]
    messages = [{"localId": i + 1, "type": "text", "content": t, "isSend": s, "senderDisplayName": None, "createTime": 1_700_000_000 + i, "formattedTime": "2024-01-01"} for i, (t, s) in enumerate(said)]
    (tmp_path / "in" / "a.json").write_text(json.dumps({"session": {"wxid": "wxid_1", "displayName": "Peer"}, "messages": messages}), encoding="utf-8")
    out = lambda name: str(tmp_path / name)
    assert command.main(["nothing"]) == 2 and command.main(["build", "x"]) == 2
    assert command.run("extract", [out("in"), out("facts")], spark) is None
    assert spark.read.json(out("facts")).where("predicate = '喜欢吃'").first().subject == "Peer"
    assert [r.content for r in command.run("search", [out("in"), "吃面,哈哈"], spark).collect()] == ["哈哈", "我爱吃面"]
    command.run("documents", [out("in"), out("docs"), "Peer"], spark)
    assert "我爱吃面" in "\n".join(r.value for r in spark.read.text(out("docs/memories")).collect())
    command.run("personas", [out("in"), out("people")], spark)
    assert [r.name for r in spark.read.json(out("people/_summary")).collect()] == ["赵老师"]
    (tmp_path / "r.jsonl").write_text('{"id": 1, "context": "a", "reply": "b", "real": "c"}\n')
    command.run("evaluate", [out("r.jsonl"), out("report")], spark)
    assert spark.read.json(out("report")).first().n == 1
    (tmp_path / "d.md").write_text('"今天论文答辩顺利结束了"\n', encoding="utf-8")
    (tmp_path / "f.json").write_text(json.dumps({"target": "t", "facts": [{"fact_id": "F_1", "subject": "t", "object": "论文答辩", "source_content": "论文答辩"}]}), encoding="utf-8")
    command.run("verify", [out("d.md"), out("f.json"), out("v")], spark)
    assert {r.status for r in spark.read.json(out("v")).collect()} <= {"PARTIAL", "UNVERIFIED"}


def test_samples_repeat(spark):
    rows = spark.range(100).selectExpr("id as msg_id", "repeat('x', cast(id % 30 as int)) as content")
    a, b = ([r.msg_id for r in samples.sampled(rows, 10, seed).collect()] for seed in (1, 1))
    assert a == b and a != [r.msg_id for r in samples.sampled(rows, 10, 2).collect()]
    assert samples.stratified(rows, 9).groupBy("bucket").count().where("count = 3").count() == 3


def test_windowed_counts_drop_what_is_late(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    parts = [[(day, "c"), (day, "c"), (day + dt.timedelta(days=3), "c")], [(day + dt.timedelta(days=3), "c")], [(day, "c")], [(day + dt.timedelta(days=9), "c")]]
    (tmp_path / "in").mkdir()
    for i, p in enumerate(parts):
        spark.createDataFrame(p, "ts timestamp, source_file string").coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        next((tmp_path / f"t{i}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, source_file string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = session_stream.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.start.day: r.cnt for r in spark.sql("select window.start as start, cnt from days").collect()}
    assert got == {1: 2, 4: 2}
