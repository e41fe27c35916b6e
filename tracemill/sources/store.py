"""The engine's own store: Parquet tables of the model, and trajectories as JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracemill import model
from tracemill.sources.lines import get, items, json_documents, raw, tables, text_of, ts_of

TABLES = ("sessions", "steps", "calls", "results")
#: Version of the stored tables; those of another version are read from the logs again.
VERSION = 2


def write(parsed: model.Parsed, path: str, mode: str = "overwrite") -> None:
    """Sessions by agent; the others are clustered by session, so that one session's rows lie together."""
    parsed.sessions.withColumn("schema_version", F.lit(VERSION)).write.mode(mode).partitionBy("agent").parquet(f"{path}/sessions")
    for t in TABLES[1:]:
        rows = getattr(parsed, t)
        rows.repartition("session_id").sortWithinPartitions("session_id").write.mode(mode).parquet(f"{path}/{t}")


def is_current(spark: SparkSession, path: str) -> bool:
    """Whether a store is there and all its sessions are of this version."""
    try:
        s = spark.read.parquet(f"{path}/sessions")
    except AnalysisException:
        return False
    return "schema_version" in s.columns and s.where(F.col("schema_version") != VERSION).isEmpty()


def read(spark: SparkSession, path: str) -> model.Parsed:
    """A store of this version; any other is an error, see is_current()."""
    if not is_current(spark, path):
        raise ValueError(f"no store of version {VERSION} in {path}; write it anew")
    sessions, *others = [spark.read.parquet(f"{path}/{t}") for t in TABLES]
    return model.Parsed(sessions.drop("schema_version"), *others)


def read_trajectories(spark: SparkSession, path: str) -> model.Parsed:
    """JSON files with one trajectory or an array of them. Of a session in several files the one with the last name wins."""
    docs = json_documents(spark, path)
    one = docs.select("file", F.explode(F.coalesce(items("v", "$"), F.array("v"))).alias("t")).where(get("t", "$.session_id").isNotNull())
    one = one.groupBy(get("t", "$.session_id").alias("session_id")).agg(F.max_by("t", "file").alias("t"), F.max("file").alias("file"))
    s = one.select("session_id", F.posexplode(items("t", "$.steps")).alias("step_idx", "s"))
    m = "$.metrics"
    steps = s.select(
        "session_id", "step_idx", raw("s", "$.step_id").alias("step_id"), get("s", "$.source").alias("source"), ts_of("s", "$.timestamp").alias("ts"), text_of("s", "$.message").alias("message"), get("s", "$.model_name").alias("model"),
        *[get("s", f"{m}.{c}", "long").alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")],
    )
    c = s.select("session_id", "step_idx", F.posexplode(items("s", "$.tool_calls")).alias("call_pos", "c"))
    calls = c.select("session_id", "step_idx", "call_pos", get("c", "$.tool_call_id").alias("call_id"), get("c", "$.function_name").alias("tool_name"), raw("c", "$.arguments").alias("arguments"))
    r = s.select("session_id", F.explode(items("s", "$.observation.results")).alias("r"))
    results = r.select("session_id", get("r", "$.source_call_id").alias("call_id"), text_of("r", "$.content").alias("content"), F.coalesce(get("r", "$.is_error", "boolean"), F.lit(False)).alias("is_error"))
    sessions = one.select("session_id", "file", get("t", "$.project_path").alias("project"), get("t", "$.agent.model_name").alias("model"), ts_of("t", "$.created_at").alias("created_at"), ts_of("t", "$.updated_at").alias("updated_at"), get("t", "$.parent_trajectory_ref.session_id").alias("parent_id"))
    return tables("trajectory", sessions, steps, calls, results)
