"""Dataclaw JSONL: one session a line."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracemill.functions.text import stable_id
from tracemill.model import Parsed
from tracemill.sources.lines import get, items, json_lines, raw, tables, text_of, ts_of


def read(spark: SparkSession, path: str) -> Parsed:
    """A session without an id gets one from its file and content."""
    lines, rejected = json_lines(spark, path)
    rows = lines.withColumn("session_id", F.coalesce(get("v", "$.session_id"), stable_id("dataclaw", F.col("session"), F.to_json("v"))))
    m = rows.select("session_id", get("v", "$.model").alias("model"), F.posexplode(items("v", "$.messages")).alias("step_idx", "m"))
    role = get("m", "$.role")
    source = F.when(role == "assistant", "agent").when(role == "user", "user").otherwise("system")
    steps = m.select("session_id", "step_idx", source.alias("source"), ts_of("m", "$.timestamp").alias("ts"), text_of("m", "$.content").alias("message"), F.when(source == "agent", F.col("model")).alias("model"))
    c = m.select("session_id", "step_idx", F.posexplode(items("m", "$.tool_uses")).alias("call_pos", "c"))
    calls = c.select("session_id", "step_idx", "call_pos", F.concat_ws("-", "session_id", F.col("step_idx").cast("string"), F.col("call_pos").cast("string")).alias("call_id"), get("c", "$.tool").alias("tool_name"), raw("c", "$.input").alias("arguments"))
    sessions = rows.select("session_id", "file", get("v", "$.project").alias("project"), get("v", "$.model").alias("model"), ts_of("v", "$.start_time").alias("created_at"))
    none = calls.select("session_id", "call_id").limit(0)
    return tables("dataclaw", sessions, steps, calls, none, rejected)
