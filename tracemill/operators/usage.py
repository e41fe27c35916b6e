"""Tool usage: a partial aggregate for each session and tool, and the final one for each tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_session(calls: DataFrame) -> DataFrame:
    """session_id, tool_name, calls, errors. Such partial results can be stored and merged by tool_usage()."""
    return calls.where("tool_name is not null").groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))


def tool_usage(partial: DataFrame, sessions: DataFrame) -> DataFrame:
    """tool_name, call_count, avg_per_session, error_rate over all valid sessions, those without the tool included.

    The number of sessions is one row; where there is no session there is no result.
    """
    n = sessions.agg(F.countDistinct("session_id").alias("n")).where("n > 0")
    totals = partial.groupBy("tool_name").agg(F.sum("calls").alias("call_count"), F.sum("errors").alias("errors"))
    return totals.join(F.broadcast(n)).select(
        "tool_name",
        "call_count",
        F.round(F.col("call_count") / F.col("n").cast("double"), 2).alias("avg_per_session"),
        F.round(F.col("errors") / F.col("call_count").cast("double"), 3).alias("error_rate"),
    )


def per_session_maps(partial: DataFrame) -> DataFrame:
    """session_id and two maps from tool to calls and to errors."""
    pair = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool_name", c))))
    return partial.groupBy("session_id").agg(pair("calls").alias("tool_counts"), pair("errors").alias("tool_errors"))
