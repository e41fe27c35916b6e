"""Copilot events.jsonl: events in envelopes; those with an agent id are sessions of sub-agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.model import Parsed
from tracemill.sources.lines import get, items, json_lines, numbered, raw, tables, text_of, ts_of


def session_totals(spark: SparkSession, path: str) -> DataFrame:
    """session_id, model, requests, cost, prompt_tokens, completion_tokens, cache_read_tokens, cache_write_tokens of each model, from the last event that ends a session."""
    lines, _ = json_lines(spark, path, "events.jsonl")
    rows = lines.select("file", F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("folder"), "pos", "v", get("v", "$.type").alias("type"))
    name = rows.where("type = 'session.start'").groupBy("file").agg(F.min_by(get("v", "$.data.sessionId"), "pos").alias("main"))
    end = rows.where("type = 'session.shutdown'").groupBy("file", "folder").agg(F.max_by("v", "pos").alias("v")).join(name, "file", "left")
    m = end.select(F.coalesce("main", "folder").alias("session_id"), F.explode(F.try_variant_get("v", "$.data.modelMetrics", "map<string,variant>")).alias("model", "m"))
    n = lambda k, kind="long": F.coalesce(get("m", k, kind), F.lit(0).cast(kind))
    return m.select("session_id", "model", n("$.requests.count").alias("requests"), n("$.requests.cost", "double").alias("cost"), (n("$.usage.inputTokens") + n("$.usage.cacheReadTokens")).alias("prompt_tokens"), n("$.usage.outputTokens").alias("completion_tokens"), n("$.usage.cacheReadTokens").alias("cache_read_tokens"), n("$.usage.cacheWriteTokens").alias("cache_write_tokens"))


def read(spark: SparkSession, path: str) -> Parsed:
    """The session is named by its start event, or else by its folder. A call that never completed has an error as its result."""
    lines, rejected = json_lines(spark, path, "events.jsonl")
    rows = lines.select("file", F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("folder"), "pos", "v", get("v", "$.type").alias("type"), get("v", "$.agentId").alias("agent_id"), ts_of("v", "$.timestamp").alias("ts"))
    meta = rows.where("type = 'session.start'").groupBy("file").agg(F.min_by(get("v", "$.data.sessionId"), "pos").alias("main"), F.min_by(get("v", "$.data.context.cwd"), "pos").alias("project"))
    rows = rows.join(meta, "file", "left").withColumn("main", F.coalesce("main", "folder")).withColumn("session_id", F.when(F.col("agent_id").isNotNull(), F.concat_ws(":", "main", "agent_id")).otherwise(F.col("main")))
    rows = rows.withColumn("model", F.last(F.when(F.col("type") == "session.model_change", F.coalesce(get("v", "$.data.newModel"), get("v", "$.data.model"))), True).over(W.partitionBy("file").orderBy("pos")))
    kind = F.col("type")
    compaction, cut = kind == "session.compaction_complete", kind == "session.truncation"
    steps = rows.where(kind.isin("user.message", "assistant.message", "system.message") | compaction | cut).select(
        "session_id", "pos", "v", get("v", "$.id").alias("step_id"), "ts", F.when(kind == "assistant.message", "agent").when(kind == "user.message", "user").otherwise("system").alias("source"), F.coalesce(text_of("v", "$.data.content"), get("v", "$.data.summaryContent")).alias("message"),
        F.when(kind == "assistant.message", F.coalesce(get("v", "$.data.model"), F.col("model"))).alias("model"), get("v", "$.data.outputTokens", "long").alias("completion_tokens"), compaction.alias("is_compaction"),
    )
    steps = numbered(steps, ["pos"])
    c = steps.select("session_id", "step_idx", F.posexplode(items("v", "$.data.toolRequests")).alias("call_pos", "c"))
    calls = c.select("session_id", "step_idx", "call_pos", get("c", "$.toolCallId").alias("call_id"), get("c", "$.name").alias("tool_name"), raw("c", "$.arguments").alias("arguments"))
    done = rows.where("type = 'tool.execution_complete'").select("session_id", get("v", "$.data.toolCallId").alias("call_id"), F.coalesce(text_of("v", "$.data.result.content"), raw("v", "$.data.error.message"), raw("v", "$.data.result")).alias("content"), (~F.coalesce(get("v", "$.data.success", "boolean"), F.lit(False))).alias("is_error"))
    never = calls.select("session_id", "call_id").join(done.select("session_id", "call_id"), ["session_id", "call_id"], "left_anti").select("session_id", "call_id", F.lit("no result was recorded").alias("content"), F.lit(True).alias("is_error"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file"), F.first("project", True).alias("project"), F.first(F.when(F.col("agent_id").isNotNull(), F.col("main")), True).alias("parent_id"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("pos"))).alias("model"))
    return tables("copilot", sessions, steps, calls, done.unionByName(never), rejected)
