"""A stored search index: what queries read of it, how it is refreshed, and the fields that fill it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill import manifests, model
from tracemill.functions import text
from tracemill.operators import context, dashboard, edges, phases, report, search, search_index, sessions, sets

FIELDS = ["user_prompts", "agent_messages", "tool_calls"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    vocabulary = [f"word{k}" for k in range(40)] + ["testing", "tested", "queries", "query"]
    rows = [(f"s{i}", " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12))), " ".join(r.choice(vocabulary) for _ in range(5)), "") for i in range(60)]
    return spark.createDataFrame(rows, "session_id string, user_prompts string, agent_messages string, tool_calls string")


def tables(index):
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    return rows(index.postings, "field", "token", "doc", "tf", "dl"), rows(index.lengths, "field", "doc", "dl"), rows(index.vocabulary, "field", "token", "n", F.round("idf", 9)), rows(index.fields, "field", "docs", F.round("avgdl", 9), F.round("mean_idf", 9))


def test_stored_index_is_the_built_one(spark, docs, tmp_path):
    built, kept = search.build(docs, "session_id", FIELDS), search.stored(docs, "session_id", FIELDS, str(tmp_path / "a"))
    assert tables(built) == tables(kept) == tables(built.write(str(tmp_path / "b")))
    for q in ("query word1", "testing", "word3 wor"):
        of = lambda index: {r.doc: round(r.composite, 9) for r in search.blended(index, q, search.SESSION_WEIGHTS).collect()}  # noqa: E731,B023
        assert of(built) == of(kept)


def read_files(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_a_query_reads_the_files_of_its_tokens(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "FILE_ROWS", 9)
    kept = search.stored(docs, "session_id", FIELDS, str(tmp_path / "a"))
    every, words = read_files(kept.postings), read_files(kept.vocabulary)
    assert len(every) > 20 and len(words) > 8
    # A common token fills many files; one that is not there none.
    some, few = kept.of(["word1"]), kept.of(["word1", "nothing"])
    assert 1 < len(read_files(some[0])) < len(every) and len(read_files(some[1])) <= 2 and read_files(few[0]) == read_files(some[0])
    # A beginning of words reads its range of the dictionary.
    asked = kept._files("dictionary", [("quer", "quer\U0010ffff")])
    assert len([f for fs in asked.values() for f in fs]) <= 2 and kept.completions("quer", 10) == ["query"]
    assert kept.completions("word3", 3) == ["word3", "word30", "word31"] and kept.completions("x", 5) == []
    monkeypatch.setattr(search_index, "HELD_KEYS", 3)
    again = search.Index.read(spark, str(tmp_path / "a"))
    assert again.keys is None and read_files(again.of(["word1"])[0]) == read_files(some[0])
    composite = lambda index: {r.doc: round(r.composite, 9) for r in search.blended(index, "word3 wor", search.SESSION_WEIGHTS).collect()}
    assert composite(again) == composite(search.build(docs, "session_id", FIELDS))


def folder_size(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_segments_add_subtract_and_merge(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"word{k}" for k in range(300)]
    text_ = lambda: " ".join(r.choice(vocabulary) for _ in range(60))
    now = {f"s{k}": (text_(), text_(), "") for k in range(400)}
    frame = lambda: spark.createDataFrame([(k, *v) for k, v in now.items()], "session_id string, user_prompts string, agent_messages string, tool_calls string")
    stamp = lambda df: df.select("session_id", F.xxhash64(*FIELDS).alias("stamp"))
    index, path = search.stored(frame(), "session_id", FIELDS, str(tmp_path / "i")), tmp_path / "i"
    first = folder_size(path)
    monkeypatch.setattr(search_index, "MOST_SEGMENTS", 4)
    for turn in range(4):
        before = stamp(frame())
        before = spark.createDataFrame(before.collect(), before.schema)
        now.pop(f"s{turn}")
        now[f"s{turn + 10}"] = ("", "only here now" if turn < 3 else "", "tool" if turn == 1 else "")
        now[f"new{turn}"] = (text_(), "", "")
        size = folder_size(path)
        index = search.refresh(index, frame(), sets.change_kind(stamp(frame()), before, "session_id", "stamp"), "session_id", FIELDS)
        assert len(index.segments) == [2, 3, 4, 1][turn]
        if turn < 3:
            assert folder_size(path) - size < 0.35 * first  # 3 of 400 documents; small files have a fixed part
        assert tables(index) == tables(search.build(frame(), "session_id", FIELDS))
    for q in ("word1 word2", "only here", "tool"):
        of = lambda i: {x.doc: round(x.composite, 9) for x in search.blended(i, q, search.SESSION_WEIGHTS).collect()}  # noqa: E731,B023
        assert of(index) == of(search.build(frame(), "session_id", FIELDS))
    assert search_index.vacuum(spark, str(path)) == 5 and tables(search.Index.read(spark, str(path))) == tables(index)
    stale = search.Index.read(spark, str(path))
    diff = spark.createDataFrame([("s50", "removed")], "session_id string, kind string")
    search.refresh(stale, frame(), diff, "session_id", FIELDS)
    with pytest.raises(RuntimeError, match="meanwhile"):
        search.refresh(stale, frame(), diff, "session_id", FIELDS)


def test_refresh_equals_a_rebuild(spark, docs, tmp_path):
    old = docs.where("session_id <> 's3'").withColumn("user_prompts", F.when(F.col("session_id") == "s7", "stale words").otherwise(F.col("user_prompts")))
    gone = spark.createDataFrame([("s99", "gone words", "x", "")], docs.schema)
    before, now = old.unionByName(gone), docs
    stamp = lambda df: df.select("session_id", F.xxhash64(*FIELDS).alias("stamp"))
    diff = sets.change_kind(stamp(now), stamp(before), "session_id", "stamp")
    assert {(r.session_id, r.kind) for r in diff.where("kind <> 'unchanged'").collect()} == {("s3", "new"), ("s7", "changed"), ("s99", "removed")}
    kept = search.stored(before, "session_id", FIELDS, str(tmp_path / "a"))
    fresh = search.refresh(kept, now, diff, "session_id", FIELDS, str(tmp_path / "b"))
    assert tables(fresh) == tables(search.build(now, "session_id", FIELDS))


def test_other_versions_are_refused(spark, docs, tmp_path):
    search.stored(docs.limit(3), "session_id", FIELDS, str(tmp_path / "a"))
    manifests.commit(spark, str(tmp_path / "a"), lambda content: content | {"version": 2})
    with pytest.raises(ValueError, match="version"):
        search.Index.read(spark, str(tmp_path / "a"))


def test_fields_hold_sub_agents_and_long_arguments(spark):
    sessions_ = spark.createDataFrame([("m", None, 2), ("b", "m", 5), ("a", "m", 9), ("aa", "a", 1), ("lost", "gone", 1), ("x", "y", 1), ("y", "x", 1)], "session_id string, parent_id string, created_at long")
    steps = spark.createDataFrame([(s, k, "user", f"{s.upper()}{k}") for s in ("m", "a", "b", "aa", "lost", "x") for k in (0, 1)], "session_id string, step_idx int, source string, message string")
    calls = spark.createDataFrame([("aa", 1, 0, "c", "Bash", json.dumps({"command": "z" * 600})), ("m", 0, 0, "c", "Read", "{}")], "session_id string, step_idx int, call_pos int, call_id string, tool_name string, arguments string")
    results = spark.createDataFrame([("aa", "c", "done", False)], "session_id string, call_id string, content string, is_error boolean")
    got = {r.session_id: (r.user_prompts, r.tool_calls) for r in search.session_fields(model.Parsed(sessions_, steps, calls, results)).collect()}
    assert got == {"m": ("m0 m1 aa0 aa1 b0 b1 a0 a1", "read bash " + "z" * 500 + " done"), "lost": ("lost0 lost1", ""), "x": ("x0 x1", ""), "y": ("", "")}


def test_fields_of_sessions(spark):
    steps = spark.createDataFrame([("s", 0, "user", "Fix IT"), ("s", 1, "agent", "Looking"), ("s", 2, "agent", None), ("s", 3, "user", "more"), ("t", 0, "user", "x")], "session_id string, step_idx int, source string, message string")
    calls = spark.createDataFrame([("s", 1, 0, "a", "Read", json.dumps({"file_path": "A.py", "line": 3})), ("s", 1, 1, "b", "Bash", json.dumps({"command": "x" * 300})), ("s", 2, 0, "c", "Note", "free text")], "session_id string, step_idx int, call_pos int, call_id string, tool_name string, arguments string")
    results = spark.createDataFrame([("s", "a", "Found " + "y" * 300, False), ("s", "c", "", False)], "session_id string, call_id string, content string, is_error boolean")
    got = {r.session_id: r for r in search.session_fields(model.Parsed(steps.select("session_id").distinct(), steps, calls, results)).collect()}
    assert (got["s"].user_prompts, got["s"].agent_messages) == ("fix it more", "looking") and got["t"].tool_calls == ""
    assert got["s"].tool_calls == f"read a.py bash {'x' * 300} found {'y' * 194} note free text"


def test_plain_matches_without_an_index(spark):
    s = spark.createDataFrame([("ab-1", "Hello there"), ("cd-2", "other"), ("ef-3", None)], "session_id string, first_message string")
    assert {r.doc for r in search.plain_matches(s, "HELLO").collect()} == {"ab-1"} and {r.doc for r in search.plain_matches(s, "cd").collect()} == {"cd-2"} and search.plain_matches(s, " ").count() == 0


def test_chains_are_packed_together(spark):
    rows = [("a1", "p", "2024-01-01 00:00:00", 40), ("b", "p", "2024-01-02 00:00:00", 70), ("a2", "p", "2024-01-03 00:00:00", 50), ("c1", "p", "2024-01-04 00:00:00", 80), ("c2", "p", "2024-01-05 00:00:00", 60)]
    c = spark.createDataFrame(rows, "session_id string, project string, created_at string, tokens long").withColumn("created_at", F.col("created_at").cast("timestamp"))
    links = spark.createDataFrame([("a2", "a1"), ("a1", "a1"), ("c1", "c1"), ("c2", "c1")], "session_id string, head string")
    got = {r.session_id: r.batch for r in context.pack_chains(c, links, 100).collect()}
    assert got["a1"] == got["a2"] and got["c1"] != got["c2"] and len(got) == 5
    size = dict((r[0], r[3]) for r in rows)
    assert all(sum(size[s] for s in got if got[s] == b) <= 100 for b in set(got.values()))


def test_synthesis_asks_once_more(spark):
    ctx = spark.createDataFrame([(f"s{i}", f"text {i}") for i in range(2)], "session_id string, context string")
    info = spark.createDataFrame([("s0", "p"), ("s1", "q")], "session_id string, project string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    steps = spark.createDataFrame([("s0", 1), ("s1", 2)], "session_id string, step_idx int")

    def backend(t):
        if t.startswith("[{"):
            assert {d["title"] for d in json.loads(t)} == {"slow s0", "slow s1"}
            return json.dumps([{"title": "slow s0", "severity": 4}, {"title": "made up", "severity": 5, "refs": [{"session_id": "s9", "start": 1}]}])
        i = t[-1]
        return json.dumps([{"title": f"slow s{i}", "severity": 2, "refs": [{"session_id": f"s{i}", "start": int(i) + 1}]}])

    got = report.analyse(ctx, info, steps, backend, synthesis=True).collect()
    assert [(r.title, r.severity, [tuple(x) for x in r.refs]) for r in got] == [("slow s0", 4, [("s0", 1, 1)])]


def test_contexts_with_arguments_metadata_and_order(spark):
    steps = spark.createDataFrame([("s", 0, "user", "go"), ("s", 1, "agent", "ok")], "session_id string, step_idx int, source string, message string")
    calls = spark.createDataFrame([("s", 1, 0, "Read", '{"file_path": "a.py"}'), ("s", 1, 1, "Bash", '{"command": "ls"}')], "session_id string, step_idx int, call_pos int, tool_name string, arguments string")
    body = context.extracts(context.with_arguments(steps, calls)).first().context
    assert "AGENT: ok   TOOL: Read file_path=a.py   TOOL: Bash command=ls" in body
    meta = context.metadata_extracts(spark.createDataFrame([("s", "/w", "2024-01-01")], "session_id string, project string, created_at string"), steps).first().context
    assert meta.startswith("=== SESSION: s ===") and "PROJECT: /w" in meta and "go" not in meta
    wanted = spark.createDataFrame([("x", 0), ("s", 1), ("t", 2)], "session_id string, position int")
    have, missing = context.in_order(wanted, spark.createDataFrame([("t", "T"), ("s", "S")], "session_id string, context string"))
    assert [tuple(r) for r in have.orderBy("idx").collect()] == [("s", "S", 0), ("t", "T", 1)] and [r.session_id for r in missing.collect()] == ["x"]


def test_final_metrics_of_untimed_and_unpriced_steps(spark):
    rows = [("s", 0, None, 5, 1, None, None), ("s", 1, "2024-01-01 23:59:00", 3, 2, None, "Read"), ("s", 2, "2024-01-02 00:01:00", None, None, None, None), ("u", 0, None, 1, 1, None, None)]
    s = spark.createDataFrame(rows, "session_id string, step_idx int, ts string, prompt_tokens long, completion_tokens long, cost_usd double, tool_name string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cache_read_tokens", F.lit(0)).withColumn("cache_write_tokens", F.lit(0))
    got = {r.session_id: r for r in dashboard.final_metrics(s).collect()}
    assert (got["s"].prompt_tokens, got["s"].steps, got["s"].tool_calls, got["s"].duration, got["s"].cost_usd) == (8, 3, 1, 120, None)
    assert {k: (v.messages, v.tokens) for k, v in got["s"].days.items()} == {"2024-01-01": (2, 11), "2024-01-02": (1, 0)} and got["u"].days is None
    calls = spark.createDataFrame([("s",), ("s",)], "session_id string")
    assert {r.session_id: r.tool_calls for r in dashboard.final_metrics(s, calls).collect()} == {"s": 2, "u": 0}


def test_light_owned_and_text_values(spark):
    s = spark.createDataFrame([("a", "x", "long", 1)], "session_id string, agent string, system_prompt string, n int")
    assert sessions.light(s).columns == ["session_id", "agent", "n"]
    nested = s.select("session_id", F.struct("system_prompt", "n").alias("extra"))
    assert sessions.light(nested, "extra").schema["extra"].dataType.names == ["n"]
    assert sessions.owned(s, spark.createDataFrame([("a", "y")], "session_id string, agent string")).count() == 0
    v = spark.createDataFrame([('"x"',), ('["a", {"text": "b"}, 3]',), ('{"k": 1}',), ("null",), ("2.5",)], "j string").select(text.as_text(F.parse_json("j")).alias("t"))
    assert [r.t for r in v.collect()] == ["x", "a\nb\n3", '{"k":1}', "", "2.5"]
    m = "---\nname: 'my skill'\ntags:\n  - one\n  - \"two\"\nlist: [a, 'b']\n# note\nname: last\ndeep:\n  key: x\n---\nbody"
    got = spark.createDataFrame([(m,), ("no matter",)], "m string").select(text.front_matter_values(F.col("m")).alias("v")).collect()
    assert got[0].v["name"] == "last" and got[0].v["tags"] == "one, two" and got[0].v["list"] == "a, b" and got[1].v == {}


def test_long_sessions_stay_linear(spark):
    n = 200_000
    base = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").cast("int").alias("step_idx"))
    steps = base.withColumn("ts", (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("step_idx") * 10).cast("timestamp"))
    kids = steps.where("step_idx % 10 = 3").select(F.concat(F.lit("k"), F.col("step_idx")).alias("session_id"), F.lit("s").alias("parent_id"), (F.col("ts") + F.expr("interval 25 seconds")).alias("created_at"), F.lit(None).cast("int").alias("spawn_step"))
    got = sessions.place_children(kids, steps).agg(F.count("*").alias("n"), F.count_if(F.substring("session_id", 2, 20).cast("int") + 2 == F.least("step_idx", F.lit(n))).alias("right")).first()
    assert got.n == n // 10 and got.right >= got.n - 1
    segs = spark.range(n // 4).select(F.lit("s").alias("session_id"), (F.col("id") * 4).cast("int").alias("start_idx"), (F.col("id") * 4 + 3).cast("int").alias("end_idx"), F.lit("mixed").alias("phase"))
    calls = base.withColumn("tool_name", F.when(F.col("step_idx") % 4 == 0, "Bash").otherwise("Read"))
    assert phases.dominant_category(segs, calls).groupBy("dominant").count().collect()[0]["count"] == n // 4
    assert sessions.anchored_phases(segs, base.where("step_idx % 10 = 0")).count() > n // 4
    c = base.select("session_id", F.col("step_idx").alias("idx"), F.col("step_idx").cast("string").alias("call_id"), F.lit("Read").alias("tool_name"), F.lit("p").alias("path"), (F.col("step_idx") % 50 == 0).alias("is_error"))
    e = {r.relation: r["count"] for r in edges.all_edges(c).groupBy("relation").count().collect()}
    assert e == {"error_retry": n // 50, "sequential": n - 1 - n // 50}


def test_one_pass_gives_the_edges_of_each_kind(spark):
    r = random.Random(8)
    rows = [(f"s{i % 5}", i // 5, f"c{i}", r.choice(["Read", "Grep", "Edit", "Bash", "WebFetch"]), r.choice(["a", "b", "", None]), r.random() < 0.3) for i in range(600)]
    c = spark.createDataFrame(rows, "session_id string, idx int, call_id string, tool_name string, path string, is_error boolean")
    got = sorted(map(tuple, edges.all_edges(c).collect()))
    strong = [f(c) for f in (edges.read_before_write, edges.search_then_read, edges.write_then_test, edges.multi_edit, edges.error_retry)]
    one = strong[0]
    for x in strong[1:]:
        one = one.unionByName(x)
    assert got == sorted(map(tuple, one.unionByName(edges.sequential(c, one)).collect()))
