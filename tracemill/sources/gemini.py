"""Gemini session JSON: one document a file, tool results inside the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import model
from tracemill.model import Parsed
from tracemill.operators.sessions import interleave
from tracemill.sources.lines import get, inline_agents, items, json_documents, raw, tables, text_of, ts_of

#: Tools that run a sub-agent and return its report.
AGENT_TOOLS = ("codebase_investigator",)
FOLDER = "([^/]+)/(?:chats/)?[^/]+$"


def projects(spark: SparkSession, path: str) -> DataFrame:
    """folder, project: which path a folder stands for, by its name or by the SHA-256 of the path, from projects.json in its present and its older form."""
    docs = json_documents(spark, path, "projects.json")
    now = docs.select(F.explode(F.try_variant_get("v", "$.projects", "map<string,string>")).alias("project", "folder"))
    old = docs.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("project", "x")).where("project <> 'projects'").select("project", get("x", "$.hash").alias("folder"))
    both = now.unionByName(old)
    return both.unionByName(both.select("project", F.sha2("project", 256).alias("folder"))).where("folder is not null").groupBy("folder").agg(F.min("project").alias("project"))


def compressions(spark: SparkSession, path: str, sessions: DataFrame) -> DataFrame:
    """session_id, marker_idx, ts of each /compress command that the folder's logs.json has within a session's time."""
    logs = json_documents(spark, path, "logs.json").select(F.regexp_extract("file", FOLDER, 1).alias("folder"), F.explode(items("v", "$")).alias("e"))
    typed = logs.where((get("e", "$.type") == "user") & (F.trim(get("e", "$.message")) == "/compress")).select("folder", ts_of("e", "$.timestamp").alias("ts"))
    found = typed.join(sessions.select("session_id", "folder", "created_at", "updated_at"), "folder").where("ts between created_at and updated_at")
    return found.select("session_id", F.unix_micros("ts").alias("marker_idx"), "ts").distinct()


def read(spark: SparkSession, path: str) -> Parsed:
    """Its prompt tokens already count those from the cache.

    A file of kind subagent has its parent's session id and is named by its file; newer
    sub-agents are known by task and report alone. A /compress command of the folder's log
    stands as a system step where it was given.
    """
    docs = json_documents(spark, path, "session-*.json")
    child = F.coalesce(get("v", "$.kind") == "subagent", F.lit(False))
    folder = F.regexp_extract("file", FOLDER, 1)
    docs = docs.select("file", F.when(child, F.col("session")).otherwise(F.coalesce(get("v", "$.sessionId"), F.col("session"))).alias("session_id"), F.when(child, get("v", "$.sessionId")).alias("parent_id"), get("v", "$.projectHash").alias("hash"), folder.alias("folder"), "v")
    known = projects(spark, path)
    docs = docs.join(known.withColumnRenamed("project", "by_name"), "folder", "left").join(known.select(F.col("folder").alias("hash"), F.col("project").alias("by_hash")), "hash", "left").withColumn("project", F.coalesce("by_name", "by_hash", "hash"))
    m = docs.select("session_id", F.posexplode(items("v", "$.messages")).alias("step_idx", "m"))
    kind = get("m", "$.type")
    steps = m.select(
        "session_id", "step_idx", get("m", "$.id").alias("step_id"), F.when(kind == "gemini", "agent").when(kind == "user", "user").otherwise("system").alias("source"), ts_of("m", "$.timestamp").alias("ts"), text_of("m", "$.content").alias("message"), get("m", "$.model").alias("model"),
        get("m", "$.tokens.input", "long").alias("prompt_tokens"), get("m", "$.tokens.output", "long").alias("completion_tokens"), get("m", "$.tokens.cached", "long").alias("cache_read_tokens"),
    )
    c = m.select("session_id", "step_idx", F.posexplode(items("m", "$.toolCalls")).alias("call_pos", "c"))
    calls = c.select("session_id", "step_idx", "call_pos", get("c", "$.id").alias("call_id"), get("c", "$.name").alias("tool_name"), raw("c", "$.args").alias("arguments"))
    results = c.where(get("c", "$.result", "variant").isNotNull() | (get("c", "$.status") == "error")).select("session_id", get("c", "$.id").alias("call_id"), raw("c", "$.result").alias("content"), (get("c", "$.status") == "error").alias("is_error"))
    last = steps.groupBy("session_id").agg(F.max_by("model", F.when(F.col("model").isNotNull(), F.col("step_idx"))).alias("model"))
    sessions = docs.select("session_id", "parent_id", "file", "folder", "project", ts_of("v", "$.startTime").alias("created_at"), ts_of("v", "$.lastUpdated").alias("updated_at")).join(last, "session_id", "left")
    markers = compressions(spark, path, sessions.where("parent_id is null"))
    place = interleave(model.conform(steps, model.STEPS), markers)
    of_step = place.where("kind = 'step'").select("session_id", F.col("key").cast("int").alias("step_idx"), F.col("place").cast("int").alias("at"))
    moved = lambda df: df.join(of_step, ["session_id", "step_idx"]).withColumn("step_idx", F.col("at")).drop("at")
    cut = place.where("kind = 'marker'").select("session_id", F.col("place").cast("int").alias("step_idx"), F.concat(F.lit("gemini-compress-"), F.col("key")).alias("step_id"), F.lit("system").alias("source"), F.timestamp_micros("key").alias("ts"), F.lit("[Context compressed via /compress]").alias("message"), F.lit(True).alias("is_compaction"))
    steps = moved(model.conform(steps, model.STEPS)).unionByName(model.conform(cut, model.STEPS))
    return inline_agents(tables("gemini", sessions, steps, moved(calls), results), AGENT_TOOLS, ("objective",), "$[0].functionResponse.response.output")
