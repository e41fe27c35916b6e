"""Reading agent logs: lines of JSON in order, as VARIANT, with lines that can't be read set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill import model
from tracemill.functions import times
from tracemill.streaming import following


def json_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(file, session, pos, v) of each readable line, (file, pos, value) of the others; blank lines are skipped.

    session is the file's name without its ending; pos orders the lines of a file, also one
    that Spark reads in several splits. A folder that following.follow() keeps gives the lines
    of the logs that it follows.
    """
    if following.is_followed(spark, path):
        now = following.current_lines(spark, path, glob)
        raw = now.select(F.col("line").alias("value"), "file", F.xxhash64("file").alias("block"), F.col("at").alias("id"))  # a file's lines stay together
        return _parsed(raw)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return _parsed(raw)


def _parsed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = raw.where("trim(value) <> ''").select("file", F.regexp_extract("file", "([^/]+?)\\.[^./]+$", 1).alias("session"), F.struct("block", "id").alias("pos"), "value", F.try_parse_json("value").alias("v"))
    return rows.where("v is not null").drop("value"), rows.where("v is null").select("file", "pos", "value")


def json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, session, v) of each file that is one JSON document."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"))
    return raw.select("file", F.regexp_extract("file", "([^/]+?)\\.[^./]+$", 1).alias("session"), F.try_parse_json("value").alias("v")).where("v is not null")


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def raw(v: str | Column, path: str) -> Column:
    """The JSON text of a part, a string's own text if it is one."""
    return F.try_variant_get(v, path, "string")


def is_array(v: str | Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY")


def items(v: str | Column, path: str) -> Column:
    """The items of a JSON array as array<variant>; null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def text_of(v: str | Column, path: str, separator: str = "\n\n") -> Column:
    """Text of a message that is a string or a list of parts of which some have text."""
    parts = F.filter(F.transform(items(v, path), lambda p: F.coalesce(get(p, "$.text"), F.when(F.schema_of_variant(p) == "STRING", p.cast("string")))), lambda t: t.isNotNull() & (t != ""))
    return F.when(is_array(v, path), F.array_join(parts, separator)).otherwise(raw(v, path))


def ts_of(v: str | Column, path: str) -> Column:
    return times.parse_any(raw(v, path))


def numbered(rows: DataFrame, order: list[str], by: str = "session_id") -> DataFrame:
    """rows with step_idx, from 0 in order within a session."""
    return rows.withColumn("step_idx", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)


def tables(agent: str, sessions: DataFrame, steps: DataFrame, calls: DataFrame, results: DataFrame, rejected: DataFrame | None = None) -> model.Parsed:
    """The model's tables, start and end of sessions filled in from their steps."""
    steps = model.conform(steps, model.STEPS)
    s = model.with_bounds(model.conform(sessions.withColumn("agent", F.lit(agent)), model.SESSIONS), steps)
    return model.Parsed(model.conform(s, model.SESSIONS), steps, model.conform(calls, model.CALLS), model.conform(results, model.RESULTS), rejected)


def with_spawns(p: model.Parsed, named: DataFrame) -> model.Parsed:
    """p with the call that started each sub-agent. named has child, call_id and session_id, the session of the call; of several calls the first counts."""
    calls = p.calls.select("session_id", "call_id", "step_idx")
    first = named.join(calls, ["session_id", "call_id"]).groupBy(F.col("child").alias("session_id"), F.col("session_id").alias("parent_id")).agg(F.min(F.struct("step_idx", "call_id")).alias("__s"))
    s = p.sessions.drop("spawn_step", "spawn_call").join(first, ["session_id", "parent_id"], "left").withColumn("spawn_step", F.col("__s.step_idx")).withColumn("spawn_call", F.col("__s.call_id"))
    return model.Parsed(model.conform(s, model.SESSIONS), p.steps, p.calls, p.results, p.rejected)


def inline_agents(p: model.Parsed, tools: tuple[str, ...], task: tuple[str, ...], report: str | None = None) -> model.Parsed:
    """p with a session for each call of a tool that runs a sub-agent and leaves nothing of it but its report.

    Such a session has two steps at the time of the call's step: the task, from the first of
    the arguments `task` that is there, and the report, at the path `report` of the result if
    it is such a JSON. A call without a report has no session.
    """
    found = p.results.where("trim(content) <> ''").select("session_id", "call_id", "content")
    parent = p.sessions.select("session_id", "agent", "project", F.col("model").alias("of"), "file")
    made = p.calls.where(F.col("tool_name").isin(*tools)).join(found, ["session_id", "call_id"]).join(p.steps.select("session_id", "step_idx", "ts"), ["session_id", "step_idx"]).join(parent, "session_id")
    text = F.coalesce(get(F.try_parse_json("content"), report), F.col("content")) if report else F.col("content")
    asked = F.coalesce(*[F.nullif(get(F.try_parse_json("arguments"), f"$.{k}"), F.lit("")) for k in task], F.concat(F.lit("(started by "), "tool_name", F.lit("; its task was not recorded)")))
    made = made.select(F.concat_ws(":", "session_id", F.lit("subagent"), F.coalesce("call_id", "tool_name")).alias("child"), F.col("session_id").alias("parent_id"), "agent", "project", "of", "file", "ts", "step_idx", "call_id", F.array(F.struct(F.lit("user").alias("source"), asked.alias("message")), F.struct(F.lit("agent").alias("source"), text.alias("message"))).alias("two"))
    sessions = made.select(F.col("child").alias("session_id"), "agent", "project", F.col("of").alias("model"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "parent_id", "file", F.col("step_idx").alias("spawn_step"), F.col("call_id").alias("spawn_call"))
    steps = made.select(F.col("child").alias("session_id"), "ts", F.posexplode("two").alias("step_idx", "s")).select("session_id", "step_idx", F.concat_ws("-", "session_id", "step_idx").alias("step_id"), "s.source", "ts", "s.message")
    return model.Parsed(p.sessions.unionByName(model.conform(sessions, model.SESSIONS)), p.steps.unionByName(model.conform(steps, model.STEPS)), p.calls, p.results, p.rejected)


def prompt_tokens(v: str | Column, fresh: str, cached: str) -> Column:
    """Prompt tokens count those read from the cache."""
    return F.coalesce(get(v, fresh, "long"), F.lit(0)) + F.coalesce(get(v, cached, "long"), F.lit(0))
