"""Views of the benchmark tables as sessions, steps and tool calls, in DataFrame form and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Event type: tool that it stands for. Other types are plain messages.
EVENT_TOOLS = {"view": "Read", "click": "Grep", "purchase": "Edit", "signup": "Bash", "error": "WebFetch"}
MODELS = ("openai/gpt-5-mini-2025-08-07", "models/gemini-2.5-pro", "<synthetic>", "qwen/qwen3-max", "kimi-k2.5")
ERROR_ABOVE = 120.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step for each event: a user is a session, its events in time order its steps.

    Every tenth event is a message of the user; the others call one tool each.
    """
    e = table(spark, sf_dir, "events")
    agent = F.col("event_id") % 10 != 0
    tool = F.create_map(*[F.lit(x) for kv in EVENT_TOOLS.items() for x in kv])
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    prompt = F.floor(F.col("value") * 10).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"),
        (F.row_number().over(order) - 1).alias("step_idx"),
        F.col("event_id").alias("step_id"),
        F.when(agent, "agent").otherwise("user").alias("source"),
        F.col("ts"),
        F.when(agent, F.element_at(tool, F.col("event_type"))).alias("tool_name"),
        (agent & (F.col("value") > ERROR_ABOVE)).alias("is_error"),
        F.get_json_object("props", "$.k").alias("path"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % len(MODELS) + 1).cast("int")).alias("model"),
        prompt.alias("prompt_tokens"),
        F.floor("value").cast("long").alias("completion_tokens"),
        F.floor(prompt / 4).cast("long").alias("cache_read_tokens"),
        F.floor(prompt / 10).cast("long").alias("cache_write_tokens"),
    )


def sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, project, agent of each user; a twentieth of the users have no project."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    return ids.select(u.cast("string").alias("session_id"), F.when(u % 20 != 0, F.concat(F.lit("/work/p"), u % 7)).alias("project"), F.concat(F.lit("agent"), u % 3).alias("agent"))


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, step_idx, source, message of each turn."""
    c = table(spark, sf_dir, "conversations")
    source = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("step_idx"), source.alias("source"), F.col("text").alias("message"))


#: The same views for DuckDB.
STEPS_SQL = f"""
st AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step_idx, event_id AS step_id,
  CASE WHEN event_id % 10 <> 0 THEN 'agent' ELSE 'user' END AS source, ts,
  CASE WHEN event_id % 10 <> 0 THEN CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TOOLS.items())} END END AS tool_name,
  event_id % 10 <> 0 AND value > {ERROR_ABOVE} AS is_error, json_extract_string(props, '$.k') AS path,
  CASE user_id % 5 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS))} END AS model,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens,
  CAST(floor(floor(value * 10) / 4) AS BIGINT) AS cache_read_tokens, CAST(floor(floor(value * 10) / 10) AS BIGINT) AS cache_write_tokens FROM events),
se AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN user_id % 20 <> 0 THEN '/work/p' || (user_id % 7) END AS project, 'agent' || (user_id % 3) AS agent FROM events)"""
CONV_SQL = """
cs AS (SELECT conv_id AS session_id, turn AS step_idx, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS source, text AS message FROM conversations)"""
