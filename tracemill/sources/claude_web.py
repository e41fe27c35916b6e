"""Claude web export: one JSON array of conversations."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.model import Parsed
from tracemill.sources.lines import get, items, json_documents, raw, tables, text_of, ts_of


def read(spark: SparkSession, path: str) -> Parsed:
    """Calls and results without ids are paired in order: the n-th of a conversation with the n-th."""
    docs = json_documents(spark, path, "*.json").select("file", F.explode(items("v", "$")).alias("c")).where(get("c", "$.uuid").isNotNull())
    m = docs.select(get("c", "$.uuid").alias("session_id"), F.posexplode(items("c", "$.chat_messages")).alias("step_idx", "m"))
    said = F.coalesce(F.nullif(text_of("m", "$.content"), F.lit("")), text_of("m", "$.text"))
    steps = m.select("session_id", "step_idx", get("m", "$.uuid").alias("step_id"), F.when(get("m", "$.sender") == "assistant", "agent").otherwise("user").alias("source"), ts_of("m", "$.created_at").alias("ts"), said.alias("message"))
    p = m.select("session_id", "step_idx", F.posexplode(items("m", "$.content")).alias("at", "p"))
    order = W.partitionBy("session_id").orderBy("step_idx", "at")
    uses = p.where(get("p", "$.type") == "tool_use").withColumn("n", F.row_number().over(order)).withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "step_idx").orderBy("at")) - 1)
    back = p.where(get("p", "$.type") == "tool_result").withColumn("n", F.row_number().over(order))
    named = F.coalesce(get("p", "$.id"), F.concat(F.col("session_id"), F.lit("-call-"), F.col("n").cast("string")))
    calls = uses.select("session_id", "step_idx", "call_pos", named.alias("call_id"), get("p", "$.name").alias("tool_name"), raw("p", "$.input").alias("arguments"))
    to = F.coalesce(get("p", "$.tool_use_id"), F.concat(F.col("session_id"), F.lit("-call-"), F.col("n").cast("string")))
    results = back.select("session_id", to.alias("call_id"), text_of("p", "$.content").alias("content"), F.coalesce(get("p", "$.is_error", "boolean"), F.lit(False)).alias("is_error"))
    sessions = docs.select(get("c", "$.uuid").alias("session_id"), "file", ts_of("c", "$.created_at").alias("created_at"), ts_of("c", "$.updated_at").alias("updated_at"))
    return tables("claude_web", sessions, steps, calls, results)
