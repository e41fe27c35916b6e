"""Versions of stores, point lookups, index scans, files without sessions, recommendations and digests."""

import json
import re

import pytest
from pyspark.sql import functions as F

from test_sources import T, database, put

from tracemill import sinks, sources
from tracemill.functions import redact
from tracemill.operators import context, report, search
from tracemill.sources import openclaw, sqlite, store
from tracemill.streaming import incremental


def test_a_store_of_another_version_is_written_anew(spark, tmp_path):
    put(tmp_path / "in/x.jsonl", {"session_id": "d1", "messages": [{"role": "user", "content": "a", "timestamp": T(1)}]})
    p, path = sources.read(spark, "dataclaw", str(tmp_path / "in")), str(tmp_path / "store")
    assert not store.is_current(spark, path)
    store.write(p, path)
    assert store.is_current(spark, path) and store.read(spark, path).sessions.columns == p.sessions.select(*[c for c in store.read(spark, path).sessions.columns]).columns
    spark.read.parquet(f"{path}/sessions").withColumn("schema_version", F.lit(1)).write.parquet(str(tmp_path / "s1"))
    spark.read.parquet(str(tmp_path / "s1")).write.mode("overwrite").partitionBy("agent").parquet(f"{path}/sessions")
    with pytest.raises(ValueError, match="version"):
        store.read(spark, path)


def test_one_item_of_a_catalogue(spark, tmp_path):
    items = spark.range(5000).select(F.format_string("i%05d", "id").alias("item_id"), F.col("id").alias("n"))
    sinks.write_catalog(items, str(tmp_path / "c"))
    found = sinks.find_item(spark, str(tmp_path / "c"), "i00042")
    assert [r.n for r in found.collect()] == [42] and "EqualTo(item_id,i00042)" in found._jdf.queryExecution().executedPlan().toString()


def test_sessions_without_their_messages(spark, tmp_path):
    database(
        tmp_path / "opencode.db",
        ("CREATE TABLE session (id TEXT, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT)", ()),
        ("INSERT INTO session VALUES ('a', NULL, '/w', 't', 1740823200000, 1740823200000)", ()),
    )
    r = sqlite.session_index(spark, str(tmp_path)).first()
    assert (r.session_id, r.project, r.created_at.year) == ("a", "/w", 2025)


def test_openclaw_list_of_sessions(spark, tmp_path):
    put(tmp_path / "agents/main/sessions/sessions.json", json.dumps({"k": {"sessionId": "o1", "updatedAt": 1740823200000}, "x": {"other": 1}}))
    r = openclaw.session_index(spark, str(tmp_path)).collect()
    assert [(x.session_id, x.created_at.year) for x in r] == [("o1", 2025)]


def test_files_without_sessions_are_remembered(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "file string, stamp string")
    indexed = spark.createDataFrame([("a", "1")], "file string, stamp string")
    parsed = spark.createDataFrame([("a",), ("c",)], "file string")
    kept = incremental.fruitless(now, parsed)
    assert [tuple(r) for r in kept.collect()] == [("b", "1")]
    kinds = {r.file: r.kind for r in incremental.changes(now, indexed.unionByName(kept)).collect()}
    assert kinds == {"a": "unchanged", "b": "unchanged", "c": "new"}


def test_recommendations(spark):
    rows = [(f"i{k}", "skill", f"tool{k}", ["x"], "me", "spark joins" if k % 3 == 1 else "cooking", "", 50.0, 0.5, "2024-01-01") for k in range(12)]
    items = spark.createDataFrame(rows, "item_id string, type string, name string, topics array<string>, author string, description string, readme string, quality_score double, popularity double, updated_at string").withColumn("topics", F.array_join("topics", " "))
    chosen = search.candidates(items, "joins in spark", "2024-02-01 00:00:00", top=4)
    assert {r.name for r in chosen.collect()} == {"tool1", "tool4", "tool7", "tool10"}

    def backend(t):
        assert [x["name"] for x in json.loads(t)] == ["tool1", "tool10", "tool4", "tool7"]
        return json.dumps([{"name": "tool4", "score": 0.9, "rationale": "fits"}, {"name": "tool4", "score": 1.0}, {"name": "unknown", "score": 1.0}, {"name": "tool1", "rationale": "maybe"}])

    got = [(r.item_id, r.rationale) for r in report.recommended(items, chosen, backend).collect()]
    assert sorted(got) == [("i1", "maybe"), ("i4", "fits")]


def test_digests_by_length(spark):
    rows = [(s, i, "user" if i % 2 == 0 else "agent", "m" * 4000) for s, n in (("a", 5), ("b", 50), ("c", 220)) for i in range(n)]
    d = {r.session_id: r for r in context.digests(spark.createDataFrame(rows, "session_id string, step_idx int, source string, message string")).collect()}
    assert {k: v.depth for k, v in d.items()} == {"a": "full", "b": "medium", "c": "concise"}
    assert "m" * 3000 in d["a"].context and "m" * 1001 not in d["b"].context and "m" * 501 not in d["c"].context


def test_detected_names_are_redacted(spark):
    def detect(t):
        return [(m.start(), m.end()) for n in ("Ann", "Ann Lee", "Lee") for m in re.finditer(n, t)]

    rows = [(1, "Ann Lee met Lee"), (2, None), (3, ""), (4, "nobody")]
    got = {r.id: (r.r.text, r.r["count"]) for r in spark.createDataFrame(rows, "id int, t string").select("id", redact.redact_detected(F.col("t"), detect).alias("r")).collect()}
    assert got == {1: ("[REDACTED] met [REDACTED]", 2), 2: (None, 0), 3: ("", 0), 4: ("nobody", 0)}


def test_sessions_too_short_to_sample(spark):
    s = spark.createDataFrame([("a", 3), ("b", 10), ("c", None)], "session_id string, steps int")
    assert {tuple(r) for r in context.too_short(s).collect()} == {("a", 3), ("c", 0)}
