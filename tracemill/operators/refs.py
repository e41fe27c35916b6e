"""References of analyses to steps: resolving, checking, filling in, and what the steps referred to cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.durable import checkpointed
from tracemill.operators import intervals


def resolve(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """refs (session_id, start, end as indices) with step ids; one whose start is unknown goes, an unknown end or one equal to the start makes it a point.

    ids has session_id and step_ids, a map from index to id.
    """
    j = refs.join(ids, "session_id")
    one = lambda c: F.try_element_at("step_ids", F.col(c))
    out = j.withColumn("start_id", one("start")).withColumn("end_id", F.when(F.col("end") != F.col("start"), one("end")))
    return out.where("start_id is not null").drop("step_ids")


def ranges(refs: DataFrame, steps: DataFrame) -> DataFrame:
    """ref_id, session_id, first_idx, last_idx of refs by step ids: a missing end is a point, an unknown start nothing."""
    s = steps.select("session_id", F.col("step_id").alias("id"), "step_idx")
    a = refs.join(s.select("session_id", F.col("id").alias("start_id"), F.col("step_idx").alias("first_idx")), ["session_id", "start_id"])
    b = a.join(s.select("session_id", F.col("id").alias("end_id"), F.col("step_idx").alias("e")), ["session_id", "end_id"], "left")
    return b.select("ref_id", "session_id", "first_idx", F.greatest("first_idx", F.coalesce("e", "first_idx")).alias("last_idx"))


def cost(found: DataFrame, steps: DataFrame) -> DataFrame:
    """ref_id, steps, tokens, seconds over each reference's range; tokens and seconds are null where nothing is known."""
    hit = intervals.points_in_ranges(steps, found, "session_id", "step_idx", "first_idx", "last_idx")
    spent = F.col("prompt_tokens") + F.col("completion_tokens")
    return hit.groupBy("ref_id").agg(F.count("*").alias("steps"), F.sum(spent).alias("tokens"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"))


def back_fill(final: DataFrame, drafts: DataFrame, key: str, most: int = 3) -> DataFrame:
    """final (key, refs) with refs from all drafts of the key where it has fewer, cut to `most` again."""
    pool = drafts.groupBy(key).agg(F.flatten(F.array_sort(F.collect_list("refs"))).alias("pool"))
    j = final.join(pool, key, "left")
    better = F.size(F.coalesce("pool", F.array())) > F.size(F.coalesce("refs", F.array()))
    return j.withColumn("refs", F.slice(F.when(better, F.array_distinct("pool")).otherwise(F.coalesce("refs", F.array())), 1, most)).drop("pool")


def keep_known(rows: DataFrame, column: str, kept: DataFrame, key: str) -> DataFrame:
    """rows whose array has only the elements that kept holds, in their order; rows left without any go."""
    numbered = checkpointed(rows.withColumn("__row", F.monotonically_increasing_id()))
    each = numbered.select("__row", F.posexplode(column).alias("__at", "__x"))
    known = each.join(kept.select(F.col(key).alias("__x")), "__x", "left_semi").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__at", "__x"))).alias("__kept"))
    out = numbered.drop(column).join(known, "__row").withColumn(column, F.transform("__kept", lambda k: k.getField("__x")))
    return out.select(*rows.columns)


def first_per_name(rows: DataFrame, known: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Rows whose name is known, the first of each name."""
    r = rows.join(known.select(name).distinct(), name, "left_semi")
    return r.withColumn("__n", F.row_number().over(W.partitionBy(name).orderBy(*order))).where("__n = 1").drop("__n")


def ranked_join(ranked: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Ranked ids with what other tables know of them, inner, in the order of rank."""
    out = ranked
    for o in others:
        out = out.join(o, key)
    return out.orderBy("rank")
