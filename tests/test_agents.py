"""Sub-agents, forks and compactions as each format keeps them, in folders shaped like real ones."""

import hashlib
import json

from test_sources import T, database, put, results, steps

from tracemill import model, sources
from tracemill.sources import codex, copilot, sqlite


def links(p):
    return {r.session_id: (r.parent_id, r.spawn_step, r.spawn_call) for r in p.sessions.where("parent_id is not null").collect()}


def tree(p):
    return {(r.root, r.session_id, r.depth) for r in model.family(p.sessions).collect()}


def test_claude_agents(spark, tmp_path):
    say = lambda i, kind, content, **m: {"type": kind, "uuid": f"u{i}{m.pop('u', '')}", "sessionId": "s1", "timestamp": T(i), "cwd": "/w", "message": {"role": kind, "content": content, **m}}
    use = lambda id_, name: {"type": "tool_use", "id": id_, "name": name, "input": {}}
    back = lambda id_, text: {"type": "tool_result", "tool_use_id": id_, "content": [{"type": "text", "text": text}]}
    put(
        tmp_path / "p/s1.jsonl",
        say(0, "user", "go"),
        say(1, "assistant", [use("t1", "Task"), use("t2", "Read")], id="m1", model="x"),
        say(2, "user", [back("t1", "All done.\nagentId: ab12 (use it)"), back("t2", "agentId: ffff")]),
    )
    put(tmp_path / "p/s1/subagents/agent-ab12.jsonl", say(1, "user", "look", u="a"), say(2, "assistant", [{"type": "text", "text": "seen"}], id="m2", u="a"))
    put(tmp_path / "p/s1/subagents/agent-acompact-77.jsonl", say(3, "assistant", [{"type": "text", "text": "short"}], id="m3", u="b"))
    put(tmp_path / "p/s1/subagents/notes.jsonl", say(4, "user", "skipped", u="c"))
    p = sources.read(spark, "claude", str(tmp_path))
    assert steps(p) == [("agent-ab12", "user", "look"), ("agent-ab12", "agent", "seen"), ("agent-acompact-77", "agent", "short"), ("s1", "user", "go"), ("s1", "agent", "")]
    assert links(p) == {"agent-ab12": ("s1", 1, "t1"), "agent-acompact-77": ("s1", None, None)}
    assert {r.session_id: r.is_compaction for r in p.sessions.collect()} == {"s1": False, "agent-ab12": False, "agent-acompact-77": True}
    assert tree(p) == {("s1", "s1", 0), ("s1", "agent-ab12", 1), ("s1", "agent-acompact-77", 1)}


def test_gemini_agents_projects_and_compressions(spark, tmp_path):
    doc = lambda sid, messages, **k: json.dumps({"sessionId": sid, "projectHash": hashlib.sha256(b"/home/x/proj").hexdigest(), "startTime": T(0), "lastUpdated": T(9), "messages": messages, **k})
    call = {"id": "q", "name": "codebase_investigator", "args": {"objective": "find it"}, "status": "success", "result": [{"functionResponse": {"response": {"output": "it is there"}}}]}
    put(tmp_path / "hash1/chats/session-1.json", doc("g1", [{"id": "1", "type": "user", "content": "hi", "timestamp": T(1)}, {"id": "2", "type": "gemini", "content": "yes", "timestamp": T(5), "model": "gem", "toolCalls": [call]}]))
    put(tmp_path / "hash1/chats/session-2.json", doc("g1", [{"id": "3", "type": "gemini", "content": "sub", "timestamp": T(3)}], kind="subagent"))
    put(tmp_path / "hash1/logs.json", json.dumps([{"type": "user", "message": "/compress", "timestamp": T(4)}, {"type": "user", "message": "/quit", "timestamp": T(4)}, {"type": "user", "message": "/compress", "timestamp": "2025-03-02T10:00:00Z"}]))
    put(tmp_path / "projects.json", json.dumps({"projects": {"/home/x/proj": "hash1", "/other": "o"}}))
    p = sources.read(spark, "gemini", str(tmp_path))
    assert steps(p) == [("g1", "user", "hi"), ("g1", "system", "[Context compressed via /compress]"), ("g1", "agent", "yes"), ("g1:subagent:q", "user", "find it"), ("g1:subagent:q", "agent", "it is there"), ("session-2", "agent", "sub")]
    assert links(p) == {"session-2": ("g1", None, None), "g1:subagent:q": ("g1", 2, "q")}
    assert [r.is_compaction for r in p.steps.where("session_id = 'g1'").orderBy("step_idx").collect()] == [None, True, None]
    assert {r.project for r in p.sessions.collect()} == {"/home/x/proj"} and p.calls.first().step_idx == 2
    assert len(tree(p)) == 3


def test_projects_by_hash_and_old_form(spark, tmp_path):
    from tracemill.sources import gemini

    put(tmp_path / "a/projects.json", json.dumps({"projects": {"/p/a": "slug"}}))
    put(tmp_path / "b/projects.json", json.dumps({"/p/b": {"hash": "h-b"}}))
    got = {r.folder: r.project for r in gemini.projects(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {"slug": "/p/a", sha("/p/a"): "/p/a", "h-b": "/p/b", sha("/p/b"): "/p/b"}


def test_cursor_agents(spark, tmp_path):
    blob = lambda d: ("INSERT INTO blobs VALUES (?, ?)", (str(id(d)), json.dumps(d).encode()))
    database(tmp_path / "chats/w/c1/store.db", ("CREATE TABLE blobs (id TEXT, data BLOB)", ()), blob({"role": "user", "content": [{"type": "text", "text": "go"}]}))
    line = lambda role, *content: {"role": role, "message": {"content": list(content)}}
    text = "<timestamp>Sunday, Apr 26, 2026, 9:53 PM (UTC-4)</timestamp>\n<user_query>\nlook\n</user_query>"
    put(tmp_path / "projects/p/agent-transcripts/c1/subagents/k9.jsonl", line("user", {"type": "text", "text": text}), "broken", line("assistant", {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "u1", "name": "Read", "input": {"path": "a"}}))
    (tmp_path / "chats/w/bad").mkdir(parents=True)
    (tmp_path / "chats/w/bad/store.db").write_bytes(b"no database at all")
    p = sources.read(spark, "cursor", str(tmp_path))
    assert steps(p) == [("c1", "user", "go"), ("k9", "user", "look"), ("k9", "agent", "ok")] and links(p) == {"k9": ("c1", None, None)}
    assert p.calls.first().tool_name == "Read" and p.steps.where("session_id = 'k9' and step_idx = 0").first().ts.isoformat() == "2026-04-26T21:53:00"
    assert sorted(r.file.split("/")[-1] for r in p.rejected.collect()) == ["k9.jsonl", "store.db"] and tree(p) == {("c1", "c1", 0), ("c1", "k9", 1)}


def test_kiro_agents(spark, tmp_path):
    line = lambda kind, **data: {"version": "v1", "kind": kind, "data": data}
    put(
        tmp_path / "k1.jsonl",
        line("Prompt", message_id="a", content=[{"kind": "text", "data": "go"}]),
        line("AssistantMessage", message_id="b", content=[{"kind": "toolUse", "data": {"toolUseId": "t", "name": "subagent", "input": {"task": "dig"}}}, {"kind": "toolUse", "data": {"toolUseId": "e", "name": "subagent", "input": {"task": "none"}}}]),
        line("ToolResults", content=[{"kind": "toolResult", "data": {"toolUseId": "t", "content": "dug", "status": "success"}}, {"kind": "toolResult", "data": {"toolUseId": "e", "content": "", "status": "success"}}]),
    )
    p = sources.read(spark, "kiro", str(tmp_path))
    assert links(p) == {"k1:subagent:t": ("k1", 1, "t")}
    assert [x for x in steps(p) if x[0] != "k1"] == [("k1:subagent:t", "user", "dig"), ("k1:subagent:t", "agent", "dug")]
    assert tree(p) == {("k1", "k1", 0), ("k1", "k1:subagent:t", 1)}


def test_hermes_parents(spark, tmp_path):
    for s in ("h1", "h2"):
        put(tmp_path / f"{s}.jsonl", {"role": "user", "content": s, "timestamp": T(1)})
    database(
        tmp_path / "state.db",
        ("CREATE TABLE sessions (id TEXT, started_at REAL, ended_at REAL, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, parent_session_id TEXT)", ()),
        ("INSERT INTO sessions VALUES ('h1', 1740823200, 1740823260, 1, 2, 0, 0, NULL), ('h2', 1740823200, 1740823260, 1, 2, 0, 0, 'h1')", ()),
    )
    p = sources.read(spark, "hermes", str(tmp_path))
    assert links(p) == {"h2": ("h1", None, None)} and tree(p) == {("h1", "h1", 0), ("h1", "h2", 1)}


def test_codebuddy_agents(spark, tmp_path):
    e = lambda i, **k: {"id": f"e{i}", "timestamp": 1740823200000 + i, **k}
    put(
        tmp_path / "b1.jsonl",
        e(0, type="message", role="user", content=[{"type": "input_text", "text": "go"}]),
        e(1, type="function_call", callId="c1", name="Agent", arguments="{}", providerData={"messageId": "m"}),
        e(2, type="function_call_result", callId="c1", status="completed", output={"text": "started\ntask_id: agent-x1"}),
        e(3, type="function_call", callId="c2", name="Agent", arguments="{}", providerData={"messageId": "m"}),
        e(4, type="function_call_result", callId="c2", status="completed", output={"text": "ok"}, providerData={"toolResult": {"renderer": {"value": json.dumps({"taskId": "agent-x2"})}}}),
    )
    for n in (1, 2):
        put(tmp_path / f"b1/subagents/agent-x{n}.jsonl", e(5, type="message", role="user", content=[{"type": "input_text", "text": f"do {n}"}]))
    p = sources.read(spark, "codebuddy", str(tmp_path))
    assert links(p) == {"agent-x1": ("b1", 1, "c1"), "agent-x2": ("b1", 1, "c2")} and len(tree(p)) == 3


def test_opencode_agents_and_todos(spark, tmp_path):
    row = lambda t, *v: (f"INSERT INTO {t} VALUES ({', '.join('?' * len(v))})", v)
    database(
        tmp_path / "opencode.db",
        ("CREATE TABLE session (id TEXT, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT)", ()),
        ("CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, data TEXT)", ()),
        ("CREATE TABLE part (id TEXT, message_id TEXT, session_id TEXT, time_created INT, data TEXT)", ()),
        ("CREATE TABLE todo (session_id TEXT, content TEXT, status TEXT, priority TEXT, position INT)", ()),
        row("session", "o1", None, "/w", "t", 1740823200000, 1740823200000),
        row("session", "o2", "o1", "/w", "t", 1740823200000, 1740823200000),
        row("message", "m1", "o1", 1740823200000, json.dumps({"role": "assistant"})),
        row("part", "p1", "m1", "o1", 1740823200000, json.dumps({"type": "tool", "callID": "c", "tool": "task", "state": {"status": "completed", "input": {}, "output": "x", "metadata": {"sessionId": "o2"}}})),
        row("todo", "o1", "write", "pending", "high", 0),
    )
    p = sources.read(spark, "opencode", str(tmp_path))
    assert links(p) == {"o2": ("o1", 0, "c")} and p.rejected.count() == 0
    assert [tuple(r) for r in sqlite.todos(spark, str(tmp_path)).collect()] == [("o1", 0, "write", "pending", "high")]


def test_codex_threads_and_old_usage(spark, tmp_path):
    e = lambda i, kind, **payload: {"timestamp": T(i), "type": kind, "payload": payload}
    say = lambda i, text: e(i, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": text}])
    put(tmp_path / "rollout-1.jsonl", e(0, "session_meta", id="c1", cwd="/w"), say(1, "a"), e(2, "event_msg", type="token_count", info={"prompt_tokens": 7, "completion_tokens": 3, "input_tokens_details": {"cache_read_tokens": 2}}))
    put(tmp_path / "rollout-2.jsonl", e(0, "session_meta", id="c2", cwd="/w", source={"subagent": {"thread_spawn": {"parent_thread_id": "c1"}}}), say(1, "b"))
    put(tmp_path / "rollout-3.jsonl", e(0, "session_meta", id="c3", cwd="/w"), say(1, "c"))
    database(
        tmp_path / "state_5.sqlite",
        ("CREATE TABLE threads (id TEXT, rollout_path TEXT, created_at INT, source TEXT, cwd TEXT, title TEXT, tokens_used INT, model TEXT, first_user_message TEXT, cli_version TEXT)", ()),
        ("INSERT INTO threads VALUES ('c3', '/r/rollout-3.jsonl', 1740823200, ?, '/w', 't', 9, 'm', 'hello', '1')", (json.dumps({"subagent": {"thread_spawn": {"parent_thread_id": "c1"}}}),)),
    )
    p = sources.read(spark, "codex", str(tmp_path))
    assert links(p) == {"c2": ("c1", None, None), "c3": ("c1", None, None)}
    row = p.steps.where("session_id = 'c1'").first()
    assert (row.prompt_tokens, row.completion_tokens, row.cache_read_tokens) == (9, 3, 2)
    t = codex.threads(spark, str(tmp_path)).first()
    assert (t.session_id, t.parent_id, t.tokens, t.first_message, t.created_at.year) == ("c3", "c1", 9, "hello", 2025)


def test_copilot_totals(spark, tmp_path):
    put(tmp_path / "x/events.jsonl", {"type": "session.start", "data": {"sessionId": "z"}}, {"type": "session.shutdown", "data": {"modelMetrics": {"m-1": {"requests": {"count": 3, "cost": 1.5}, "usage": {"inputTokens": 10, "outputTokens": 4, "cacheReadTokens": 5}}}}})
    assert [tuple(r) for r in copilot.session_totals(spark, str(tmp_path)).collect()] == [("z", "m-1", 3, 1.5, 15, 4, 5, 0)]


def test_results_stay_with_their_calls(spark, tmp_path):
    put(tmp_path / "k2.jsonl", {"version": "v1", "kind": "Prompt", "data": {"message_id": "a", "content": []}})
    p = sources.read(spark, "kiro", str(tmp_path))
    assert results(p) == {} and p.sessions.count() == 1
