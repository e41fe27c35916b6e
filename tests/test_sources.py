"""Each agent's log format on a small fixture of its own."""

import json
import sqlite3

import pytest

from tracemill import model, sources
from tracemill.operators import usage


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def database(path, *statements):
    path.parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(path)
    for sql, args in statements:
        con.execute(sql, args)
    con.commit()
    con.close()


def steps(p):
    return [tuple(r) for r in p.steps.orderBy("session_id", "step_idx").select("session_id", "source", "message").collect()]


def calls(p):
    return [tuple(r) for r in p.calls.orderBy("session_id", "step_idx", "call_pos").select("call_id", "tool_name", "step_idx").collect()]


def results(p):
    return {r.call_id: (r.content, r.is_error) for r in p.results.collect()}


T = "2025-03-01T10:00:0{}Z".format


def test_claude(spark, tmp_path):
    say = lambda i, kind, content, **m: {"type": kind, "uuid": f"u{i}", "sessionId": "s1", "timestamp": T(i), "cwd": "/w", "message": {"role": kind, "content": content, **m}}
    put(
        tmp_path / "p/s1.jsonl",
        say(0, "user", "fix it"),
        say(1, "assistant", [{"type": "text", "text": "Looking."}], id="m1", model="x-1", usage={"input_tokens": 1, "output_tokens": 0}),
        say(1, "assistant", [{"type": "text", "text": "repeated"}], id="m1"),
        say(2, "assistant", [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a.py"}}], id="m1", model="x-1", usage={"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}),
        "not json",
        "",
        say(3, "user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "no file"}]}]),
        {"type": "queue-operation", "sessionId": "s1", "operation": "enqueue", "content": "taken", "timestamp": T(4)},
        {"type": "queue-operation", "sessionId": "s1", "operation": "dequeue", "timestamp": T(4)},
        {"type": "queue-operation", "sessionId": "s1", "operation": "enqueue", "content": "left", "timestamp": T(5)},
        say(6, "user", "<system-reminder>x</system-reminder>"),
    )
    put(tmp_path / "p/subagents/s9.jsonl", say(7, "user", "skipped"))
    p = sources.read(spark, "claude", str(tmp_path))
    assert steps(p) == [("s1", "user", "fix it"), ("s1", "agent", "Looking."), ("s1", "user", "left"), ("s1", "system", "<system-reminder>x</system-reminder>")]
    assert calls(p) == [("t1", "Read", 1)] and results(p) == {"t1": ("no file", True)}
    row = p.steps.where("step_idx = 1").first()
    assert (row.prompt_tokens, row.completion_tokens, row.cache_read_tokens, row.cache_write_tokens) == (8, 7, 3, 2)
    s = p.sessions.first()
    assert s.project == "/w" and s.created_at.isoformat() == "2025-03-01T10:00:00" and s.updated_at.isoformat() == "2025-03-01T10:00:06"
    assert [r.value for r in p.rejected.collect()] == ["not json"]
    nested = p.nested()
    assert [tuple(r) for r in model.unnest(nested).calls.collect()] == [tuple(r) for r in p.calls.collect()]
    assert usage.by_session(p.flat_calls()).first().errors == 1


def test_codex(spark, tmp_path):
    e = lambda i, kind, **payload: {"timestamp": T(i), "type": kind, "payload": payload}
    put(
        tmp_path / "rollout-1.jsonl",
        e(0, "session_meta", id="c1", cwd="/w"),
        e(0, "turn_context", model="m-1"),
        e(1, "response_item", type="message", role="user", content=[{"type": "input_text", "text": "go"}]),
        e(2, "response_item", type="function_call", call_id="k0", name="shell", arguments="{}"),
        e(3, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "ok"}]),
        e(4, "response_item", type="function_call", call_id="k1", name="shell", arguments='{"command":"ls"}'),
        e(5, "event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2}}),
        e(6, "response_item", type="function_call_output", call_id="k1", output=json.dumps({"output": "boom", "metadata": {"exit_code": 2}})),
        e(7, "response_item", type="function_call_output", call_id="k0", output="fine"),
    )
    p = sources.read(spark, "codex", str(tmp_path))
    assert steps(p) == [("c1", "user", "go"), ("c1", "agent", ""), ("c1", "agent", "ok")]
    assert calls(p) == [("k0", "shell", 1), ("k1", "shell", 2)]
    assert results(p) == {"k1": ("boom", True), "k0": ("fine", False)}
    row = p.steps.where("step_idx = 2").first()
    assert (row.prompt_tokens, row.completion_tokens, row.cache_read_tokens, row.model) == (14, 2, 4, "m-1")


def test_gemini(spark, tmp_path):
    doc = {"sessionId": "g1", "projectHash": "h", "startTime": T(0), "lastUpdated": T(9), "messages": [{"id": "1", "type": "user", "content": "hi", "timestamp": T(1)}, {"id": "2", "type": "gemini", "content": "yes", "timestamp": T(2), "model": "gem", "tokens": {"input": 9, "output": 3, "cached": 4}, "toolCalls": [{"id": "q", "name": "grep", "args": {"pattern": "x"}, "status": "error", "result": "bad"}]}]}
    put(tmp_path / "chats/session-1.json", json.dumps(doc, indent=1))
    p = sources.read(spark, "gemini", str(tmp_path))
    assert steps(p) == [("g1", "user", "hi"), ("g1", "agent", "yes")] and calls(p) == [("q", "grep", 1)] and results(p) == {"q": ("bad", True)}
    assert p.steps.where("step_idx = 1").first().prompt_tokens == 9 and p.sessions.first().model == "gem"


def test_dataclaw_and_store(spark, tmp_path):
    put(tmp_path / "in/x.jsonl", {"session_id": "d1", "project": "p", "model": "m", "start_time": T(0), "messages": [{"role": "user", "content": "a", "timestamp": T(1)}, {"role": "assistant", "content": "b", "tool_uses": [{"tool": "Bash", "input": {"command": "ls"}}]}]}, {"messages": [{"role": "user", "content": "c"}]})
    p = sources.read(spark, "dataclaw", str(tmp_path / "in"))
    assert [x[1:] for x in steps(p)] == [("user", "a"), ("agent", "b"), ("user", "c")]
    assert sources.store.read(spark, _stored(p, tmp_path)).steps.count() == 3
    rules = {(r.rule, r.session_id) for r in model.violations(p).collect()}
    assert ("call without result", "d1") in rules


def _stored(p, tmp_path):
    sources.store.write(p, str(tmp_path / "store"))
    return str(tmp_path / "store")


def test_claude_web_pairs_in_order(spark, tmp_path):
    use, back = {"type": "tool_use", "name": "search", "input": {}}, {"type": "tool_result", "content": [{"type": "text", "text": "found"}]}
    put(tmp_path / "c.json", json.dumps([{"uuid": "w1", "created_at": T(0), "chat_messages": [{"uuid": "a", "sender": "human", "text": "q", "created_at": T(1)}, {"uuid": "b", "sender": "assistant", "text": "", "content": [{"type": "text", "text": "r"}, use, back], "created_at": T(2)}]}]))
    p = sources.read(spark, "claude_web", str(tmp_path))
    assert [x[1:] for x in steps(p)] == [("user", "q"), ("agent", "r")] and results(p) == {calls(p)[0][0]: ("found", False)}


def test_openclaw(spark, tmp_path):
    put(
        tmp_path / "o.jsonl",
        {"type": "session", "id": "o1", "cwd": "/w", "timestamp": T(0)},
        {"type": "model_change", "modelId": "mm", "timestamp": T(0)},
        {"type": "message", "id": "1", "timestamp": T(1), "message": {"role": "user", "content": "hey"}},
        {"type": "message", "id": "2", "timestamp": T(2), "message": {"role": "assistant", "content": [{"type": "text", "text": "on it"}, {"type": "toolCall", "id": "z", "name": "exec", "arguments": {"a": 1}}], "usage": {"input": 2, "output": 3, "cacheRead": 4}}},
        {"type": "message", "id": "3", "timestamp": T(3), "message": {"role": "toolResult", "toolCallId": "z", "content": [{"type": "text", "text": "err"}], "details": {"status": "error"}}},
    )
    p = sources.read(spark, "openclaw", str(tmp_path))
    assert steps(p) == [("o1", "user", "hey"), ("o1", "agent", "on it")] and calls(p) == [("z", "exec", 1)] and results(p) == {"z": ("err", True)}
    row = p.steps.where("step_idx = 1").first()
    assert (row.prompt_tokens, row.model) == (6, "mm")


def test_codebuddy_turns(spark, tmp_path):
    at = 1_740_823_200_000
    e = lambda i, **x: {"id": f"e{i}", "timestamp": at + i * 1000, **x}
    put(
        tmp_path / "b1.jsonl",
        e(0, type="message", role="user", content=[{"type": "input_text", "text": "do"}]),
        e(1, type="message", role="assistant", content=[{"type": "output_text", "text": "one"}], providerData={"messageId": "m1", "model": "k", "rawUsage": {"prompt_tokens": 5, "completion_tokens": 6}}),
        e(2, type="function_call", callId="f", name="Bash", arguments="{}"),
        e(3, type="function_call_result", callId="f", status="failed", output={"type": "text", "text": "x"}),
        e(4, type="message", role="assistant", content=[{"type": "output_text", "text": "two"}], providerData={"messageId": "m2"}),
    )
    p = sources.read(spark, "codebuddy", str(tmp_path))
    assert [x[1:] for x in steps(p)] == [("user", "do"), ("agent", "one"), ("agent", "two")] and calls(p) == [("f", "Bash", 1)] and results(p)["f"][1] is True


def test_copilot(spark, tmp_path):
    e = lambda i, kind, agent=None, **d: {"type": kind, "id": f"i{i}", "timestamp": T(i), "data": d, **({"agentId": agent} if agent else {})}
    put(
        tmp_path / "k/events.jsonl",
        e(0, "session.start", sessionId="k1", context={"cwd": "/w"}),
        e(1, "user.message", content="go"),
        e(2, "assistant.message", content="sure", outputTokens=4, toolRequests=[{"toolCallId": "a", "name": "bash", "arguments": {}}, {"toolCallId": "b", "name": "bash", "arguments": {}}]),
        e(3, "tool.execution_complete", toolCallId="a", success=True, result={"content": "ok"}),
        e(4, "assistant.message", agent="sub", content="deep"),
    )
    p = sources.read(spark, "copilot", str(tmp_path))
    assert steps(p) == [("k1", "user", "go"), ("k1", "agent", "sure"), ("k1:sub", "agent", "deep")]
    assert results(p)["a"] == ("ok", False) and results(p)["b"][1] is True
    assert [r.session_id for r in model.top_level(p.sessions).collect()] == ["k1"]
    assert {(r.root, r.session_id) for r in model.family(p.sessions).collect()} == {("k1", "k1"), ("k1", "k1:sub")}


def test_kiro(spark, tmp_path):
    put(tmp_path / "i.jsonl", {"version": 1, "kind": "Prompt", "data": {"message_id": "1", "content": [{"kind": "text", "data": "hi"}]}}, {"version": 1, "kind": "AssistantMessage", "data": {"content": [{"kind": "text", "data": "yo"}, {"kind": "toolUse", "data": {"toolUseId": "t", "name": "fs", "input": {"p": 1}}}]}}, {"version": 1, "kind": "ToolResults", "data": {"content": [{"kind": "toolResult", "data": {"toolUseId": "t", "status": "error", "content": "bad"}}]}})
    put(tmp_path / "i.json", json.dumps({"session_id": "r1", "cwd": "/w", "created_at": T(0), "updated_at": T(5)}))
    p = sources.read(spark, "kiro", str(tmp_path))
    assert steps(p) == [("r1", "user", "hi"), ("r1", "agent", "yo")] and calls(p) == [("t", "fs", 1)] and results(p) == {"t": ("bad", True)}


def test_opencode_and_pushdown(spark, tmp_path):
    at = 1_740_823_200_000
    database(
        tmp_path / "opencode.db",
        ("CREATE TABLE session(id TEXT, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT)", ()),
        ("CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT)", ()),
        ("CREATE TABLE part(id TEXT, message_id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT)", ()),
        *[("INSERT INTO session VALUES(?,?,?,?,?,?)", (s, parent, "/w", "t", at, at + 9000)) for s, parent in (("s", None), ("child", "s"), ("other", None))],
        ("INSERT INTO message VALUES(?,?,?,?,?)", ("m1", "s", at, at, json.dumps({"role": "user"}))),
        ("INSERT INTO message VALUES(?,?,?,?,?)", ("m2", "s", at + 1, at, json.dumps({"role": "assistant", "modelID": "mo", "tokens": {"input": 3, "output": 4, "cache": {"read": 5, "write": 6}}}))),
        ("INSERT INTO part VALUES(?,?,?,?,?,?)", ("p1", "m1", "s", at, at, json.dumps({"type": "text", "text": "ask"}))),
        ("INSERT INTO part VALUES(?,?,?,?,?,?)", ("p2", "m2", "s", at, at, json.dumps({"type": "tool", "callID": "c", "tool": "bash", "state": {"status": "error", "input": {"x": 1}, "error": "no"}}))),
        ("INSERT INTO part VALUES(?,?,?,?,?,?)", ("p3", "m2", "s", at, at, "broken")),
    )
    p = sources.read(spark, "opencode", str(tmp_path))
    assert p.sessions.count() == 3 and steps(p)[0] == ("s", "user", "ask") and results(p) == {"c": ("no", True)}
    assert p.steps.where("step_idx = 1").first().prompt_tokens == 8
    one = sources.sqlite.read_opencode(spark, str(tmp_path), session_id="s")
    assert {r.session_id for r in one.sessions.collect()} == {"s", "child"}
    assert [tuple(r) for r in sources.sqlite.first_user_messages(spark, str(tmp_path)).collect()] == [("s", "ask")]
    put(tmp_path / "bad/opencode.db", "this is no database")
    assert sources.read(spark, "opencode", str(tmp_path)).sessions.count() == 3


def test_cursor(spark, tmp_path):
    blob = lambda x: json.dumps(x).encode()
    database(
        tmp_path / "u1/store.db",
        ("CREATE TABLE blobs(id TEXT, data BLOB)", ()),
        *[("INSERT INTO blobs VALUES(?,?)", (str(i), d)) for i, d in enumerate([b"\x0a\xff\x00", blob({"role": "user", "content": "q"}), blob({"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool-call", "toolCallId": "t", "toolName": "Read", "args": {}}]}), blob({"role": "tool", "content": [{"type": "tool-result", "toolCallId": "t", "result": "r"}]}), blob({"no": 1})])],
    )
    p = sources.read(spark, "cursor", str(tmp_path))
    assert steps(p) == [("u1", "user", "q"), ("u1", "agent", "a")] and calls(p) == [("t", "Read", 1)] and results(p) == {"t": ("r", False)}


def test_hermes(spark, tmp_path):
    put(tmp_path / "h1.jsonl", {"role": "user", "content": "u", "timestamp": T(1)}, {"role": "assistant", "content": "v", "timestamp": T(2), "tool_calls": [{"id": "t", "function": {"name": "terminal", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "t", "content": json.dumps({"exit_code": 1})})
    put(tmp_path / "session_h2.json", json.dumps({"session_id": "h2", "messages": [{"role": "user", "content": "snap"}]}))
    database(tmp_path / "state.db", ("CREATE TABLE sessions(id TEXT, started_at REAL, ended_at REAL, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT)", ()), ("INSERT INTO sessions VALUES(?,?,?,?,?,?,?)", ("h1", 1740823200.5, 1740823300.0, 10, 20, 5, 1)))
    p = sources.read(spark, "hermes", str(tmp_path))
    assert steps(p) == [("h1", "user", "u"), ("h1", "agent", "v"), ("h2", "user", "snap")] and results(p)["t"][1] is True
    assert p.steps.where("session_id = 'h1' and step_idx = 1").first().prompt_tokens == 15


def test_hermes_places(spark, tmp_path):
    put(tmp_path / "h1.jsonl", {"role": "session_meta", "platform": "slack", "model": "m1"}, {"role": "user", "content": "a"})
    put(tmp_path / "h2.jsonl", {"role": "user", "content": "b"})
    put(tmp_path / "session_h3.json", json.dumps({"session_id": "h3", "platform": "cli", "messages": [{"role": "user", "content": "c"}]}))
    put(tmp_path / "h4.jsonl", {"role": "user", "content": "d"})
    put(tmp_path / "sessions.json", json.dumps({"k1": {"session_id": "h1", "origin": {"platform": "other", "chat_id": "C1"}}, "k2": {"session_id": "h2", "platform": "telegram", "chat_id": "7"}, "k3": "odd"}))
    p = sources.read(spark, "hermes", str(tmp_path))
    assert {r.session_id: r.project for r in p.sessions.collect()} == {"h1": "slack://C1", "h2": "telegram://7", "h3": "hermes://cli", "h4": "hermes://local"}
    assert {r.session_id: r.model for r in p.sessions.collect()}["h1"] == "m1" and len(steps(p)) == 4


def test_openclaw_keeps_the_cost_that_it_reads(spark, tmp_path):
    from tracemill.functions import models

    say = lambda i, **usage: {"type": "message", "id": str(i), "timestamp": T(i), "message": {"role": "assistant", "model": "kimi-k2.5", "content": "x", "usage": {"input": 1000, "output": 1000, **usage}}}
    put(tmp_path / "o.jsonl", {"type": "session", "id": "o1", "cwd": "/w", "timestamp": T(0)}, say(1, cost={"total": 0.5}), say(2), say(3, cost=7))
    p = sources.read(spark, "openclaw", str(tmp_path))
    assert [r.cost_usd for r in p.steps.orderBy("step_idx").collect()] == [0.5, None, None]
    got = [r.cost_usd for r in models.with_cost(p.steps).orderBy("step_idx").collect()]
    assert got[0] == 0.5 and 0 < got[1] == got[2] < 0.01


def test_trajectories_last_file_wins(spark, tmp_path):
    t = lambda m: {"session_id": "x", "steps": [{"step_id": "1", "source": "user", "message": m, "timestamp": T(1)}, {"step_id": "2", "source": "agent", "message": [{"type": "text", "text": "k"}], "tool_calls": [{"tool_call_id": "c", "function_name": "Read", "arguments": {"path": "a"}}], "observation": {"results": [{"source_call_id": "c", "content": "out"}]}}]}
    put(tmp_path / "a.json", json.dumps([t("old")]))
    put(tmp_path / "b.json", json.dumps(t("new")))
    p = sources.read(spark, "trajectory", str(tmp_path))
    assert steps(p) == [("x", "user", "new"), ("x", "agent", "k")] and results(p) == {"c": ("out", False)}
    assert sources.sniff(spark, str(tmp_path), ["dataclaw", "trajectory"])[0] == "trajectory"
    both = sources.read_all(spark, {"trajectory": str(tmp_path)}).union(p)
    assert both.steps.count() == 2


def test_unknown_agent_and_archives(spark):
    import io
    import zipfile

    with pytest.raises(ValueError):
        sources.read(spark, "nobody", "/x")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/b.jsonl", "{}")
        z.writestr("a/c.exe", "x")
    assert list(sources.unzip(data.getvalue())) == ["a/b.jsonl"]
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("../b.jsonl", "{}")
    with pytest.raises(ValueError):
        sources.unzip(data.getvalue())


def test_codex_fork_leaves_out_its_parents_history(spark, tmp_path):
    e = lambda i, kind, **payload: {"timestamp": T(i), "type": kind, "payload": payload}
    say = lambda i, role, text: e(i, "response_item", type="message", role=role, content=[{"type": "input_text", "text": text}])
    put(tmp_path / "rollout-2.jsonl", e(0, "session_meta", id="kid", forked_from_id="mum"), say(1, "user", "old"), say(2, "developer", "<model_switch> now"), say(3, "user", "new"))
    put(tmp_path / "rollout-3.jsonl", e(0, "session_meta", id="free"), say(1, "user", "a"), say(2, "developer", "<model_switch> x"))
    p = sources.read(spark, "codex", str(tmp_path))
    assert steps(p) == [("free", "user", "a"), ("free", "system", "<model_switch> x"), ("kid", "user", "new")]
    assert {r.session_id: r.parent_id for r in p.sessions.collect()} == {"kid": "mum", "free": None}
