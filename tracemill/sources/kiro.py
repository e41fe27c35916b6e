"""Kiro: JSONL of messages beside a JSON snapshot of the same name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions.text import stable_id
from tracemill.model import Parsed
from tracemill.sources.lines import get, inline_agents, items, json_documents, json_lines, numbered, raw, tables


def read(spark: SparkSession, path: str) -> Parsed:
    """Messages have no times; their order is that of the lines. A message without an id gets one from its session and place. A sub-agent is known by its task and report alone."""
    lines, rejected = json_lines(spark, path)
    head = json_documents(spark, path).select("session", get("v", "$.session_id").alias("sid"), get("v", "$.cwd").alias("project"), F.try_to_timestamp(get("v", "$.created_at")).alias("created_at"), F.try_to_timestamp(get("v", "$.updated_at")).alias("updated_at"), get("v", "$.session_state.rts_model_state.model_info.model_id").alias("model"))
    rows = lines.join(head, "session", "left").select(F.coalesce("sid", "session").alias("session_id"), "file", "project", "created_at", "updated_at", "model", "pos", "v", get("v", "$.kind").alias("kind"))
    parts = items("v", "$.data.content")
    text = F.array_join(F.filter(F.transform(parts, lambda p: F.when(get(p, "$.kind") == "text", get(p, "$.data"))), lambda t: t.isNotNull()), "\n\n")
    steps = rows.where("kind in ('Prompt', 'AssistantMessage', 'Compaction')").select(
        "session_id", "pos", "v", F.when(F.col("kind") == "AssistantMessage", "agent").when(F.col("kind") == "Prompt", "user").otherwise("system").alias("source"), F.coalesce(F.nullif(text, F.lit("")), get("v", "$.data.summary")).alias("message"), F.when(F.col("kind") == "AssistantMessage", F.col("model")).alias("model"), get("v", "$.data.message_id").alias("mid"), (F.col("kind") == "Compaction").alias("is_compaction"),
    )
    steps = numbered(steps, ["pos"]).withColumn("step_id", F.coalesce("mid", stable_id("kiro", F.col("session_id"), F.col("step_idx"))))
    p = steps.select("session_id", "step_idx", F.posexplode(items("v", "$.data.content")).alias("at", "p")).where(get("p", "$.kind") == "toolUse")
    calls = p.withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "step_idx").orderBy("at")) - 1).select("session_id", "step_idx", "call_pos", get("p", "$.data.toolUseId").alias("call_id"), get("p", "$.data.name").alias("tool_name"), raw("p", "$.data.input").alias("arguments"))
    r = rows.where("kind = 'ToolResults'").select("session_id", F.explode(items("v", "$.data.content")).alias("p")).where(get("p", "$.kind") == "toolResult")
    results = r.select("session_id", get("p", "$.data.toolUseId").alias("call_id"), raw("p", "$.data.content").alias("content"), (get("p", "$.data.status") == "error").alias("is_error"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file"), *[F.first(c, True).alias(c) for c in ("project", "created_at", "updated_at", "model")])
    return inline_agents(tables("kiro", sessions, steps, calls, results, rejected), ("subagent",), ("task", "__tool_use_purpose"))
