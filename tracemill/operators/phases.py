"""Phases of a session: windows over agent steps, islands of equal phases, and absorption of single steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions.tools import category
from tracemill.operators import intervals

FRAME = 5
KINDS = ("file_read", "search", "file_write", "shell")


def step_counts(steps: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """session_id, step_idx, source, is_error and calls by kind of each step.

    calls has session_id, step_idx, tool_name; without it steps have one tool_name each.
    """
    if calls is None:
        c = category(F.col("tool_name"))
        has = F.col("tool_name").isNotNull()
        return steps.select("session_id", "step_idx", "source", "is_error", has.cast("int").alias("n"), *[(has & (c == k)).cast("int").alias(k) for k in KINDS])
    c = calls.withColumn("kind", category(F.col("tool_name"))).groupBy("session_id", "step_idx").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    return steps.select("session_id", "step_idx", "source", "is_error").join(c, ["session_id", "step_idx"], "left").fillna(0, ["n", *KINDS])


def windows(counts: DataFrame) -> DataFrame:
    """session_id, step_idx, phase of each agent step, by it and the next four agent steps."""
    w = W.partitionBy("session_id").orderBy("step_idx")
    f = w.rowsBetween(0, FRAME - 1)
    s = {k: F.sum(k).over(f) for k in ("n", *KINDS)}
    a = counts.where("source = 'agent'").select("session_id", "step_idx", *[v.alias(k) for k, v in s.items()], F.max(F.coalesce("is_error", F.lit(False))).over(f).alias("err"))
    part = lambda *k: sum((F.col(x) for x in k[1:]), F.col(k[0])) / F.col("n").cast("double")
    phase = (
        F.when(F.col("n") == 0, "planning")
        .when(F.col("err") & (part("file_read", "search", "file_write") >= 0.3), "debugging")
        .when((part("shell") >= 0.4) & (F.col("file_write") == 0) & ~F.col("err"), "verification")
        .when(part("file_write") >= 0.35, "implementation")
        .when(part("file_read", "search") >= 0.5, "exploration")
        .otherwise("mixed")
    )
    return a.select("session_id", "step_idx", phase.alias("phase"))


def segments(phases: DataFrame) -> DataFrame:
    """session_id, seg, phase, start_idx, end_idx: runs of equal phases over agent steps; bounds are step indices."""
    w = W.partitionBy("session_id").orderBy("step_idx")
    new = (F.lag("phase").over(w) != F.col("phase")) | F.lag("phase").over(w).isNull()
    return phases.withColumn("new", new.cast("int")).withColumn("seg", F.sum("new").over(w)).groupBy("session_id", "seg", "phase").agg(F.min("step_idx").alias("start_idx"), F.max("step_idx").alias("end_idx"))


def absorbed(segs: DataFrame) -> DataFrame:
    """session_id, phase, start_idx, end_idx: a segment of one step joins the one before it; equal neighbours stay apart."""
    w = W.partitionBy("session_id").orderBy("seg")
    opens = (F.col("start_idx") < F.col("end_idx")) | (F.row_number().over(w) == 1)
    g = segs.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(w))
    return g.groupBy("session_id", "grp").agg(F.min_by("phase", "seg").alias("phase"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("grp")


def dominant_category(segs: DataFrame, calls: DataFrame) -> DataFrame:
    """segs with dominant: the kind of tool called most in each, ties to the kind seen first; null without calls."""
    c = calls.where("tool_name is not null").select("session_id", "step_idx", category(F.col("tool_name")).alias("kind"))
    hit = intervals.points_in_ranges(c, segs.select("session_id", "start_idx", "end_idx"), "session_id", "step_idx", "start_idx", "end_idx")
    n = hit.groupBy("session_id", "start_idx", "kind").agg(F.count("*").alias("n"), F.min("step_idx").alias("first"))
    best = n.groupBy("session_id", "start_idx").agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("dominant"))
    return segs.join(best, ["session_id", "start_idx"], "left")
