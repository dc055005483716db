from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from colloquy.operators import annotate, clients


@pytest.fixture
def endpoint():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, body, status=200):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.reply({"data": [{"id": "small"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body, self.headers.get("Authorization")))
            if len(seen) == 1:
                return self.reply({}, 500)
            lines = body["messages"][-1]["content"].splitlines()
            self.reply({"choices": [{"message": {"content": "```json\n" + "\n".join('{"emotion": "sad", "intensity": 0.5}' for _ in lines) + "\n```"}}]})

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_key_from_environment_or_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("OTHER=1\nTHE_KEY='abc'\n")
    monkeypatch.delenv("THE_KEY", raising=False)
    assert clients.api_key("THE_KEY", [str(tmp_path / "none"), str(tmp_path / ".env")]) == "abc" and clients.api_key("NO_KEY", [str(tmp_path / ".env")]) is None
    monkeypatch.setenv("THE_KEY", "def")
    assert clients.api_key("THE_KEY", [str(tmp_path / ".env")]) == "def"


def test_client_tries_again_and_annotates(spark, endpoint):
    url, seen = endpoint
    client = clients.Client(url, key="k", prompt="say", pause=0.01)
    assert client.models() == ["small"] and clients.Client("http://127.0.0.1:9/v1").models() == []
    assert client.generate("hello") == '{"emotion": "sad", "intensity": 0.5}' and len(seen) == 2
    body, key = seen[1]
    assert body["model"] == "small" and body["messages"][0] == {"role": "system", "content": "say"} and key == "Bearer k"
    m = spark.createDataFrame([(1, "a"), (2, "b")], "msg_id bigint, content string")
    assert [(r.emotion, r.intensity) for r in annotate.RemoteAnnotator(client.annotations).annotate(m).collect()] == [("sad", 0.5)] * 2
    with pytest.raises(OSError):
        clients.Client("http://127.0.0.1:9/v1", "m", tries=2, pause=0.01).generate("x")


def test_answers_have_defaults(spark):
    r = spark.createDataFrame([(1, "晚上吃什么", "吃面"), (2, "在吗", "[旺柴]")], "id bigint, context string, reply string")
    by_rules = {x.id: (x.style_score, x.passed) for x in clients.style_scores(r).collect()}
    assert by_rules == {1: (5, True), 2: (3, False)}
    said = lambda texts: ['{"style_score": 2, "issues": ["x"], "passed": false}' if "吃" in t else "9" for t in texts]
    assert {x.id: (x.style_score, list(x.issues)) for x in clients.style_scores(r, said).collect()} == {1: (2, ["x"]), 2: (3, ["forbidden_mark"])}

    def broken(texts):
        raise OSError("away")

    assert {x.id: x.style_score for x in clients.style_scores(r, broken).collect()} == {1: 5, 2: 3}
    kinds = lambda texts: ['{"context_relevance": "direct_answer"}' if "吃" in t else "what?" for t in texts]
    assert {x.id: x.relevance for x in clients.relevance(r, kinds).collect()} == {1: "direct_answer", 2: "unknown"}
    assert {x.id: x.reply for x in clients.replies(r, lambda texts: ['"好" '] * (len(texts) - 1)).collect()} in ({1: "好", 2: ""}, {1: "", 2: ""}, {1: "好", 2: "好"})
    chunks = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "sender string, chunk bigint, text string")
    got = {x.chunk: x.profile for x in clients.profiles(chunks, "sender", lambda texts: ['{"a": 1}' if t == "x" else "no" for t in texts]).collect()}
    assert got == {0: '{"a": 1}', 1: None}
