"""How complete a parsed session is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(counts: DataFrame) -> DataFrame:
    """counts (session_id, lines, skipped, calls, orphan_calls, results, orphan_results) with score from 0 to 1."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    score = 1 - 0.5 * part("skipped", "lines") - 0.3 * part("orphan_calls", "calls") - 0.2 * part("orphan_results", "results")
    return counts.select("*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def orphan_counts(calls: DataFrame, results: DataFrame) -> DataFrame:
    """session_id, calls, orphan_calls, results, orphan_results; calls and results have session_id and call_id."""
    a = calls.select("session_id", "call_id", F.lit(1).alias("c")).distinct()
    b = results.select("session_id", "call_id", F.lit(1).alias("r")).distinct()
    both = a.join(b, ["session_id", "call_id"], "full")
    return both.groupBy("session_id").agg(F.count("c").alias("calls"), F.count_if(F.col("r").isNull()).alias("orphan_calls"), F.count("r").alias("results"), F.count_if(F.col("c").isNull()).alias("orphan_results"))
