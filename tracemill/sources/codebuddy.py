"""CodeBuddy JSONL: flat events; a turn is a run of events with one message id."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.model import Parsed
from tracemill.sources.lines import get, json_lines, prompt_tokens, raw, tables, text_of, ts_of, with_spawns


def read(spark: SparkSession, path: str) -> Parsed:
    """An agent's event without a message id goes on with the turn before it. A file in the folder `subagents` of another one is the session of a sub-agent, which the result of a call names."""
    lines, rejected = json_lines(spark, path)
    rows = lines.select(F.col("session").alias("session_id"), "file", "pos", "v", get("v", "$.type").alias("type"), get("v", "$.role").alias("role"), ts_of("v", "$.timestamp").alias("ts"), get("v", "$.providerData.messageId").alias("mid"))
    w = W.partitionBy("session_id").orderBy("pos")
    is_user = (F.col("type") == "message") & (F.col("role") != "assistant")
    events = rows.where("type in ('message', 'function_call', 'reasoning')").withColumn("mid", F.when(is_user, F.concat(F.lit("user-"), F.to_json("pos"))).otherwise(F.col("mid")))
    events = events.withColumn("mid", F.last("mid", True).over(w))
    new = (F.lag("mid").over(w) != F.col("mid")) | F.lag("mid").over(w).isNull()
    turns = events.withColumn("new", new.cast("int")).withColumn("step_idx", F.sum("new").over(w) - 1).withColumn("user", is_user)
    said = F.when(F.col("type") == "message", text_of("v", "$.content"))
    u = "$.providerData.rawUsage"
    steps = turns.groupBy("session_id", "step_idx").agg(
        F.min("ts").alias("ts"),
        F.when(F.min_by("user", "pos"), F.min_by("role", "pos")).otherwise("agent").alias("source"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))), lambda x: x.getField("t")), "\n\n").alias("message"),
        F.max(get("v", "$.providerData.model")).alias("model"),
        F.max(F.when(get("v", f"{u}.prompt_tokens", "long").isNotNull(), prompt_tokens("v", f"{u}.prompt_tokens", "$.none"))).alias("prompt_tokens"),
        F.max(get("v", f"{u}.completion_tokens", "long")).alias("completion_tokens"),
        F.max(get("v", f"{u}.prompt_tokens_details.cached_tokens", "long")).alias("cache_read_tokens"),
        F.bool_or(F.coalesce(get("v", "$.providerData.agent") == "compact", F.lit(False))).alias("is_compaction"),
    )
    c = turns.where("type = 'function_call'")
    calls = c.withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "step_idx").orderBy("pos")) - 1).select("session_id", "step_idx", "call_pos", get("v", "$.callId").alias("call_id"), get("v", "$.name").alias("tool_name"), raw("v", "$.arguments").alias("arguments"))
    failed = F.coalesce(get("v", "$.status") != "completed", F.lit(False))
    results = rows.where(F.col("type").isin("function_call_result", "function_call_output")).select("session_id", get("v", "$.callId").alias("call_id"), text_of("v", "$.output").alias("content"), failed.alias("is_error"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file"), F.min(F.nullif(F.regexp_extract("file", "([^/]+)/subagents/[^/]+$", 1), F.lit(""))).alias("parent_id"), F.max_by(get("v", "$.providerData.model"), F.when(get("v", "$.providerData.model").isNotNull(), F.col("pos"))).alias("model"), F.first(get("v", "$.cwd"), True).alias("project"))
    p = tables("codebuddy", sessions, steps, calls, results, rejected)
    task = F.coalesce(get(F.try_parse_json(get("v", "$.providerData.toolResult.renderer.value")), "$.taskId"), F.nullif(F.regexp_extract(text_of("v", "$.output"), "task_id:\\s*(agent-\\w+)", 1), F.lit("")))
    named = rows.where(F.col("type").isin("function_call_result", "function_call_output")).select("session_id", get("v", "$.callId").alias("call_id"), task.alias("child")).where("child is not null")
    return with_spawns(p, named)
