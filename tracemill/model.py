"""The session model: tables of sessions, steps, tool calls and results, their nested form, and the rules that data must keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracemill.durable import checkpointed

SESSIONS = "session_id string, agent string, project string, model string, created_at timestamp, updated_at timestamp, parent_id string, file string, spawn_step int, spawn_call string, is_compaction boolean"
#: parent_id, spawn_step and spawn_call say which call of which session started a sub-agent; is_compaction marks one that only condensed its parent's history.
STEPS = "session_id string, step_idx int, step_id string, source string, ts timestamp, message string, model string, prompt_tokens long, completion_tokens long, cache_read_tokens long, cache_write_tokens long, is_compaction boolean, cost_usd double"
#: cost_usd is what the log itself says a step cost, for the few agents that write it; null elsewhere.
CALLS = "session_id string, step_idx int, call_pos int, call_id string, tool_name string, arguments string"
RESULTS = "session_id string, call_id string, content string, is_error boolean"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns and types of a table of the model; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ddl).fields])


@dataclass
class Parsed:
    """What a source gives. rejected holds file, line number and text of lines that could not be read."""

    sessions: DataFrame
    steps: DataFrame
    calls: DataFrame
    results: DataFrame
    rejected: DataFrame | None = None

    def union(self, other: Parsed) -> Parsed:
        """Both; the first one's session wins where both have an id."""
        new = other.sessions.join(self.sessions.select("session_id"), "session_id", "left_anti")
        keep = lambda df: df.join(new.select("session_id"), "session_id", "left_semi")
        return Parsed(self.sessions.unionByName(new), *[getattr(self, t).unionByName(keep(getattr(other, t))) for t in ("steps", "calls", "results")])

    def nested(self) -> DataFrame:
        """One row for each session with its steps, and their calls with results, as arrays in order."""
        r = self.results.groupBy("session_id", "call_id").agg(F.max_by(F.struct("content", "is_error"), F.col("content").isNotNull()).alias("result"))
        c = self.calls.join(r, ["session_id", "call_id"], "left")
        by_step = c.groupBy("session_id", "step_idx").agg(F.array_sort(F.collect_list(F.struct("call_pos", "call_id", "tool_name", "arguments", "result"))).alias("calls"))
        s = self.steps.join(by_step, ["session_id", "step_idx"], "left")
        cols = [f.name for f in T._parse_datatype_string(STEPS).fields if f.name != "session_id"]
        steps = s.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*cols, "calls"))).alias("steps"))
        return self.sessions.join(steps, "session_id", "left")

    def flat_calls(self) -> DataFrame:
        """Calls in order over the session with their results: what usage, phases and edges read."""
        w = W.partitionBy("session_id").orderBy("step_idx", "call_pos")
        r = self.results.groupBy("session_id", "call_id").agg(F.bool_or("is_error").alias("is_error"))
        c = self.calls.where("call_id is not null and call_id <> ''").join(r, ["session_id", "call_id"], "left")
        return c.select("session_id", "step_idx", (F.row_number().over(w) - 1).alias("idx"), "call_id", "tool_name", "arguments", F.coalesce("is_error", F.lit(False)).alias("is_error"))


def unnest(nested: DataFrame) -> Parsed:
    """The tables of a nested table."""
    s = nested.select("session_id", F.explode("steps").alias("s")).select("session_id", "s.*")
    c = s.select("session_id", "step_idx", F.explode("calls").alias("c")).select("session_id", "step_idx", "c.*")
    results = c.where("result is not null").select("session_id", "call_id", "result.content", "result.is_error")
    return Parsed(nested.drop("steps"), conform(s, STEPS), conform(c, CALLS), conform(results, RESULTS))


def with_bounds(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """sessions with missing start and end taken from the first and last timed step by position."""
    t = steps.where("ts is not null").groupBy("session_id").agg(F.min_by("ts", "step_idx").alias("a"), F.max_by("ts", "step_idx").alias("b"))
    return sessions.join(t, "session_id", "left").withColumn("created_at", F.coalesce("created_at", "a")).withColumn("updated_at", F.coalesce("updated_at", "b")).drop("a", "b")


def violations(p: Parsed) -> DataFrame:
    """rule, severity, session_id of each broken rule: unsafe ids, repeated step ids, results without a call, calls without a result, repeated call ids."""
    ids = p.sessions.where(~F.regexp_like("session_id", F.lit("^[A-Za-z0-9._:@-]+$")))
    again = p.steps.where("step_id is not null").groupBy("session_id", "step_id").count().where("count > 1")
    calls = p.calls.where("call_id is not null").groupBy("session_id", "call_id").count().where("count > 1")
    alone = p.results.join(p.calls.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti")
    open_ = p.calls.where("call_id is not null").join(p.results.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti")
    out = None
    for rule, severity, rows in (("unsafe id", "error", ids), ("repeated step id", "error", again), ("result without call", "error", alone), ("call without result", "warning", open_), ("repeated call id", "warning", calls)):
        part = rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "session_id").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def top_level(sessions: DataFrame) -> DataFrame:
    return sessions.where("parent_id is null")


def family(sessions: DataFrame, depth: int = 20) -> DataFrame:
    """root, session_id, depth: each session under its topmost ancestor, level by level; below `depth` levels nothing is followed. Sessions of a loop have no root."""
    links = checkpointed(sessions.where("parent_id is not null").select(F.col("parent_id").alias("up"), F.col("session_id").alias("child")))
    out = level = sessions.where("parent_id is null").select(F.col("session_id").alias("root"), "session_id", F.lit(0).alias("depth"))
    for i in range(1, depth + 1):
        level = checkpointed(level.join(links, F.col("session_id") == F.col("up")).select("root", F.col("child").alias("session_id"), F.lit(i).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
