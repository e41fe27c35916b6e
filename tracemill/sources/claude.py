"""Claude JSONL: messages in chunks that share an id, tool calls and results as parts of messages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.model import Parsed
from tracemill.operators.sessions import spawned
from tracemill.sources.lines import get, is_array, items, json_lines, numbered, prompt_tokens, raw, tables, text_of, ts_of, with_spawns

SKIPPED = "/(?:parsed|plugins)/|/subagents/(?!agent-[^/]*$)|/history\\.jsonl$|/\\._"
#: A sub-agent's file lies in the folder of its parent's file and is named by its agent; its lines have the parent's session id.
CHILD = "([^/]+)/subagents/(agent-[^/]+)\\.jsonl$"
STARTERS = ("Agent", "Task")
#: Messages in the user's name that the program wrote.
SYSTEM_TEXT = "^\\s*(?:<(?:system-reminder|command-name|command-message|local-command|task-notification)|\\[Request interrupted|This session is being continued)"


def read(spark: SparkSession, path: str) -> Parsed:
    """Sessions by sessionId. A repeated uuid counts once; chunks of one message are joined, the last usage that is not empty counts; queue entries that were never delivered are user messages. Sub-agents' files are sessions of their own, with the call that started them where its result names the agent."""
    lines, rejected = json_lines(spark, path)
    lines = lines.where(~F.regexp_like("file", F.lit(SKIPPED)))
    rows = lines.select(
        "file", "pos", "v", F.coalesce(F.nullif(F.regexp_extract("file", CHILD, 2), F.lit("")), get("v", "$.sessionId"), F.col("session")).alias("session_id"), F.nullif(F.regexp_extract("file", CHILD, 1), F.lit("")).alias("parent_id"), get("v", "$.type").alias("type"), get("v", "$.uuid").alias("uuid"), ts_of("v", "$.timestamp").alias("ts"),
        get("v", "$.message.id").alias("message_id"), get("v", "$.operation").alias("operation"),
    )
    first = W.partitionBy("session_id", F.coalesce("uuid", F.to_json("pos"))).orderBy("pos")
    kept = rows.where("type in ('user', 'assistant')").withColumn("n", F.row_number().over(first)).where("n = 1")

    # The n-th dequeue of a session takes its n-th enqueue; what is left was never delivered.
    queue = rows.where("type = 'queue-operation' and operation in ('enqueue', 'dequeue')").withColumn("n", F.row_number().over(W.partitionBy("session_id", "operation").orderBy("pos")))
    taken = queue.where("operation = 'dequeue'").groupBy("session_id").agg(F.max("n").alias("taken"))
    queued = queue.where("operation = 'enqueue'").join(taken, "session_id", "left").where("n > coalesce(taken, 0)")

    key = F.when(F.col("type") == "assistant", F.coalesce("message_id", "uuid", F.to_json("pos"))).otherwise(F.coalesce("uuid", F.to_json("pos")))
    parts = kept.withColumn("key", key)
    usage = F.when(get("v", "$.message.usage.output_tokens", "long") > 0, F.col("v"))
    steps = parts.groupBy("session_id", "key").agg(
        F.min("pos").alias("pos"),
        F.min_by("type", "pos").alias("type"),
        F.min("ts").alias("ts"),
        F.min_by("uuid", "pos").alias("step_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text_of("v", "$.message.content").alias("t")))), lambda x: F.nullif(x.getField("t"), F.lit(""))), "\n\n").alias("message"),
        F.min_by(get("v", "$.message.model"), "pos").alias("model"),
        F.max_by(usage, F.when(usage.isNotNull(), F.col("pos"))).alias("u"),
        F.bool_and(F.coalesce(F.size(F.filter(items("v", "$.message.content"), lambda p: get(p, "$.type") == "tool_result")) == F.size(items("v", "$.message.content")), F.lit(False)) & is_array("v", "$.message.content")).alias("only_results"),
    )
    # A user's message that holds nothing but results belongs to the step that called.
    steps = steps.where("not (type = 'user' and only_results)")
    source = F.when(F.col("type") == "assistant", "agent").when(F.regexp_like(F.coalesce("message", F.lit("")), F.lit(SYSTEM_TEXT)), "system").otherwise("user")
    steps = steps.select(
        "session_id", "key", "pos", "step_id", "ts", "message", "model", source.alias("source"), prompt_tokens("u", "$.message.usage.input_tokens", "$.message.usage.cache_read_input_tokens").alias("prompt_tokens"),
        get("u", "$.message.usage.output_tokens", "long").alias("completion_tokens"), get("u", "$.message.usage.cache_read_input_tokens", "long").alias("cache_read_tokens"), get("u", "$.message.usage.cache_creation_input_tokens", "long").alias("cache_write_tokens"),
    )
    late = queued.select("session_id", F.to_json("pos").alias("key"), "pos", F.lit(None).cast("string").alias("step_id"), "ts", text_of("v", "$.content").alias("message"), F.lit(None).cast("string").alias("model"), F.lit("user").alias("source"), *[F.lit(None).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")])
    steps = numbered(steps.unionByName(late), ["pos"])

    part = parts.select("session_id", "key", "pos", F.posexplode(items("v", "$.message.content")).alias("at", "p"))
    uses = part.where(get("p", "$.type") == "tool_use").withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "key").orderBy("pos", "at")) - 1)
    calls = uses.join(steps.select("session_id", "key", "step_idx"), ["session_id", "key"]).select("session_id", "step_idx", "call_pos", get("p", "$.id").alias("call_id"), get("p", "$.name").alias("tool_name"), raw("p", "$.input").alias("arguments"))
    results = part.where(get("p", "$.type") == "tool_result").select("session_id", get("p", "$.tool_use_id").alias("call_id"), text_of("p", "$.content").alias("content"), F.coalesce(get("p", "$.is_error", "boolean"), F.lit(False)).alias("is_error"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file"), F.min("parent_id").alias("parent_id"), F.min_by(get("v", "$.cwd"), F.when(get("v", "$.cwd").isNotNull(), F.col("pos"))).alias("project"), F.min_by(get("v", "$.message.model"), F.when(get("v", "$.message.model").isNotNull(), F.col("pos"))).alias("model"))
    sessions = sessions.withColumn("is_compaction", F.contains("session_id", F.lit("acompact-")))
    p = tables("claude", sessions, steps, calls, results, rejected)
    named = spawned(p.calls.where(F.col("tool_name").isin(*STARTERS)), p.results, "agentId:\\s*([a-f0-9]+)")
    return with_spawns(p, named.select("session_id", "call_id", F.concat(F.lit("agent-"), "agent_id").alias("child")))
