"""Codex rollout JSONL: one event a line, with state that holds until the next event changes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions import times
from tracemill.functions.text import clip, exit_code
from tracemill.model import Parsed
from tracemill.sources.lines import get, json_lines, numbered, raw, tables, text_of, ts_of
from tracemill.sources.sqlite import table


#: Where a thread's source names the thread that started it.
SPAWN = "subagent.thread_spawn.parent_thread_id"


def threads(spark: SparkSession, path: str) -> DataFrame:
    """session_id, file, created_at, project, title, tokens, model, first_message, parent_id: the table of threads that stands beside the files; no file of a session is read."""
    t = table(spark, path, "state_5.sqlite", "threads", "id string, rollout_path string, created_at string, source string, cwd string, title string, tokens_used long, model string, first_user_message string")
    t = t.select(F.col("id").alias("session_id"), F.col("rollout_path").alias("rollout"), F.col("created_at").alias("created"), "source", F.col("cwd").alias("project"), "title", F.col("tokens_used").alias("tokens"), "model", F.col("first_user_message").alias("first_message"))
    parent = get(F.try_parse_json("source"), f"$.{SPAWN}")
    return t.where("session_id is not null and session_id <> ''").select("session_id", F.col("rollout").alias("file"), times.parse_any(F.col("created")).alias("created_at"), "project", "title", "tokens", "model", clip(F.col("first_message")).alias("first_message"), parent.alias("parent_id"))


def read(spark: SparkSession, path: str) -> Parsed:
    """A fork's file opens with its parent's history, which ends at a model-switch message and is left out. The model of a step is that of the last turn_context. Calls go to the agent step before them; a token_count gives the usage of the last agent step before it."""
    lines, rejected = json_lines(spark, path, "rollout-*.jsonl")
    rows = lines.select("file", "session", "pos", "v", get("v", "$.type").alias("type"), get("v", "$.payload.type").alias("kind"), ts_of("v", "$.timestamp").alias("ts"))
    meta = rows.where("type = 'session_meta'").groupBy("file").agg(F.min_by(get("v", "$.payload.id"), "pos").alias("session_id"), F.min_by(get("v", "$.payload.cwd"), "pos").alias("project"), F.min_by(get("v", "$.payload.forked_from_id"), "pos").alias("forked_from"))
    marker = (F.col("type") == "response_item") & (get("v", "$.payload.role") == "developer") & F.contains(F.left(F.ltrim(text_of("v", "$.payload.content", "")), F.lit(80)), F.lit("<model_switch>"))
    switch = rows.where(marker).groupBy("file").agg(F.min("pos").alias("switch")).join(meta.where("forked_from is not null").select("file"), "file", "left_semi")
    rows = rows.join(switch, "file", "left").where("switch is null or pos > switch or type = 'session_meta'").drop("switch")
    state = W.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("model", F.last(F.when(F.col("type") == "turn_context", get("v", "$.payload.model")), True).over(state)).join(meta, "file", "left").withColumn("session_id", F.coalesce("session_id", "session"))
    role = get("v", "$.payload.role")
    source = F.when(role == "assistant", "agent").when(role == "user", "user").otherwise("system")
    compacted = (F.col("type") == "compacted") | (F.col("kind") == "context_compacted")
    said = rows.where(((F.col("type") == "response_item") & (F.col("kind") == "message")) | compacted)
    said = said.select("session_id", "pos", "ts", F.when(compacted, "system").otherwise(source).alias("source"), text_of("v", "$.payload.content").alias("message"), "model", compacted.alias("is_compaction"))
    is_call = F.col("kind").isin("function_call", "custom_tool_call", "local_shell_call")
    made = rows.where((F.col("type") == "response_item") & is_call)
    # A run of calls that no agent message precedes opens a step of its own.
    opens = said.select("session_id", "pos", "source").unionByName(made.select("session_id", "pos", F.lit("call").alias("source")))
    w = W.partitionBy("session_id").orderBy("pos")
    lone = opens.withColumn("before", F.lag("source").over(w)).where("source = 'call' and (before is null or before not in ('agent', 'call'))")
    lone = lone.join(made.select("session_id", "pos", "ts", "model"), ["session_id", "pos"]).select("session_id", "pos", "ts", F.lit("agent").alias("source"), F.lit("").alias("message"), "model", F.lit(False).alias("is_compaction"))
    steps = numbered(said.unionByName(lone), ["pos"])

    agent = steps.where("source = 'agent'").select("session_id", F.col("pos").alias("at"), "step_idx")
    both = made.select("session_id", "pos", "v", F.lit(None).cast("int").alias("step_idx")).unionByName(agent.select("session_id", F.col("at").alias("pos"), F.lit(None).cast("variant").alias("v"), "step_idx"))
    held = both.withColumn("step_idx", F.last("step_idx", True).over(W.partitionBy("session_id").orderBy("pos", F.col("v").isNotNull()))).where("v is not null")
    calls = held.withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "step_idx").orderBy("pos")) - 1).select("session_id", "step_idx", "call_pos", get("v", "$.payload.call_id").alias("call_id"), get("v", "$.payload.name").alias("tool_name"), F.coalesce(raw("v", "$.payload.arguments"), raw("v", "$.payload.input")).alias("arguments"))
    output = F.coalesce(get(F.try_parse_json(raw("v", "$.payload.output")), "$.output"), raw("v", "$.payload.output"))
    code = F.coalesce(get(F.try_parse_json(raw("v", "$.payload.output")), "$.metadata.exit_code", "int"), exit_code(output))
    results = rows.where(F.col("kind").isin("function_call_output", "custom_tool_call_output")).select("session_id", get("v", "$.payload.call_id").alias("call_id"), output.alias("content"), (F.coalesce(code, F.lit(0)) != 0).alias("is_error"))

    # Usage: the first token_count after an agent step and before the next.
    # Older files have the numbers in info itself, and other names for them.
    n = lambda v, *names: F.coalesce(*[get(v, f"$.payload.info.{at}{k}", "long") for k in names for at in ("last_token_usage.", "")])
    counts = rows.where("type = 'event_msg' and kind = 'token_count'").where(n("v", "input_tokens", "prompt_tokens").isNotNull())
    mix = counts.select("session_id", "pos", "v", F.lit(None).cast("int").alias("step_idx")).unionByName(agent.select("session_id", F.col("at").alias("pos"), F.lit(None).cast("variant").alias("v"), "step_idx"))
    used = mix.withColumn("step_idx", F.last("step_idx", True).over(W.partitionBy("session_id").orderBy("pos"))).where("v is not null and step_idx is not null")
    used = used.groupBy("session_id", "step_idx").agg(F.min_by("v", "pos").alias("u"))
    cached = F.coalesce(n("u", "cached_input_tokens", "input_tokens_details.cache_read_tokens"), F.lit(0))
    used = used.select("session_id", "step_idx", (n("u", "input_tokens", "prompt_tokens") + cached).alias("prompt_tokens"), n("u", "output_tokens", "completion_tokens").alias("completion_tokens"), cached.alias("cache_read_tokens"))
    # A thread that another one started names it in its first line, or else in the table of threads.
    started = rows.where("type = 'session_meta'").select("session_id", get("v", f"$.payload.source.{SPAWN}").alias("starter"))
    listed = threads(spark, path).select("session_id", F.col("parent_id").alias("starter"))
    starter = started.unionByName(listed).groupBy("session_id").agg(F.max("starter").alias("starter"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file"), F.first("project", True).alias("project"), F.first("forked_from", True).alias("forked"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("pos"))).alias("model"))
    sessions = sessions.join(starter, "session_id", "left").withColumn("parent_id", F.coalesce("starter", "forked"))
    return tables("codex", sessions, steps.join(used, ["session_id", "step_idx"], "left"), calls, results, rejected)
