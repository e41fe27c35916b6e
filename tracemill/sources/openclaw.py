"""OpenClaw JSONL: session, model_change and message events; results are messages that name their call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.model import Parsed
from tracemill.sources.lines import get, items, json_documents, json_lines, numbered, prompt_tokens, raw, tables, text_of, ts_of


def session_index(spark: SparkSession, path: str) -> DataFrame:
    """session_id, created_at, updated_at of the sessions that the list beside the files names; no session is read."""
    e = json_documents(spark, path, "sessions.json").select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "e"))
    rows = e.select(get("e", "$.sessionId").alias("session_id"), ts_of("e", "$.updatedAt").alias("updated_at"), ts_of("e", "$.createdAt").alias("c")).where("session_id is not null")
    return rows.select("session_id", F.coalesce("c", "updated_at").alias("created_at"), "updated_at")


def read(spark: SparkSession, path: str) -> Parsed:
    lines, rejected = json_lines(spark, path)
    rows = lines.select("file", "session", "pos", "v", get("v", "$.type").alias("type"), ts_of("v", "$.timestamp").alias("ts"))
    meta = rows.where("type = 'session'").groupBy("file").agg(F.min_by(get("v", "$.id"), "pos").alias("session_id"), F.min_by(get("v", "$.cwd"), "pos").alias("project"))
    state = W.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("current", F.last(F.when(F.col("type") == "model_change", get("v", "$.modelId")), True).over(state)).join(meta, "file", "left").withColumn("session_id", F.coalesce("session_id", "session"))
    m = rows.where("type = 'message'").withColumn("role", get("v", "$.message.role"))
    u = "$.message.usage"
    steps = m.where("role <> 'toolResult'").select(
        "session_id", "pos", get("v", "$.id").alias("step_id"), "ts", F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "user").otherwise("system").alias("source"), text_of("v", "$.message.content").alias("message"),
        F.when(F.col("role") == "assistant", F.coalesce(get("v", "$.message.model"), F.col("current"))).alias("model"), prompt_tokens("v", f"{u}.input", f"{u}.cacheRead").alias("prompt_tokens"), get("v", f"{u}.output", "long").alias("completion_tokens"),
        get("v", f"{u}.cacheRead", "long").alias("cache_read_tokens"), get("v", f"{u}.cacheWrite", "long").alias("cache_write_tokens"),
        get("v", f"{u}.cost.total", "double").alias("cost_usd"), "v",
    )
    steps = numbered(steps, ["pos"])
    p = steps.select("session_id", "step_idx", F.posexplode(items("v", "$.message.content")).alias("at", "p")).where(get("p", "$.type").isin("toolCall", "tool_use"))
    calls = p.withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "step_idx").orderBy("at")) - 1).select("session_id", "step_idx", "call_pos", get("p", "$.id").alias("call_id"), get("p", "$.name").alias("tool_name"), F.coalesce(raw("p", "$.arguments"), raw("p", "$.input")).alias("arguments"))
    failed = F.coalesce(get("v", "$.message.isError", "boolean"), F.lit(False)) | F.coalesce(get("v", "$.message.details.status") == "error", F.lit(False))
    results = m.where("role = 'toolResult'").select("session_id", get("v", "$.message.toolCallId").alias("call_id"), text_of("v", "$.message.content").alias("content"), failed.alias("is_error"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file"), F.first("project", True).alias("project"), F.max_by("current", F.when(F.col("current").isNotNull(), F.col("pos"))).alias("model"))
    return tables("openclaw", sessions, steps, calls, results, rejected)
