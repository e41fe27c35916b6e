"""Analyses by a language model over many sessions: contexts are packed, each batch is asked, answers are checked and joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions.text import fenced
from tracemill.operators import context
from tracemill.operators import refs as refs_

REFS = "array<struct<session_id:string,start:int,end:int>>"
FINDING = "array<struct<title:string,severity:int,refs:array<struct<session_id:string,start:int,end:int>>>>"


def prompts(contexts: DataFrame, packed: DataFrame) -> DataFrame:
    """batch and context: the texts of a batch's sessions one after another. contexts has session_id and context."""
    rows = packed.select("session_id", "batch").join(contexts.select(F.col("session_id").cast("string").alias("session_id"), "context"), "session_id")
    return rows.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "context"))), lambda x: x.getField("context")), "\n\n").alias("context"))


def findings(answers: DataFrame) -> DataFrame:
    """batch, title, severity (1 to 5), refs of each finding in the answers; an answer that is no such JSON gives none."""
    f = answers.where("ok").select("batch", F.explode(F.from_json(fenced(F.col("answer")), FINDING)).alias("f"))
    return f.where("f.title is not null").select("batch", "f.title", context.severity(F.coalesce("f.severity", F.lit(1))).alias("severity"), "f.refs")


def joined(found: DataFrame, steps: DataFrame, most: int = 5, refs: int = 3) -> DataFrame:
    """title, severity, refs of all batches' findings: those of one title together, by highest severity, at most `most`.

    References to steps that don't exist go; each finding keeps the first `refs`, and one
    without any left goes. steps has session_id and step_idx.
    """
    r = found.select("title", "severity", F.explode("refs").alias("r")).select("title", "severity", F.col("r.session_id").alias("session_id"), F.col("r.start").alias("start"), F.coalesce("r.end", "r.start").alias("end")).distinct()
    known = r.join(steps.select(F.col("session_id").cast("string").alias("session_id"), F.col("step_idx").alias("start")), ["session_id", "start"], "left_semi")
    kept = known.withColumn("n", F.row_number().over(W.partitionBy("title").orderBy("session_id", "start", "end"))).where(F.col("n") <= refs)
    g = kept.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("session_id", "start", "end"))).alias("refs"))
    worst = found.groupBy("title").agg(F.max("severity").alias("severity"))
    return g.join(worst, "title").orderBy(F.desc("severity"), "title").limit(most).select("title", "severity", "refs")


def synthesised(found: DataFrame, backend: Callable[[str], str], steps: DataFrame, most: int = 5, refs: int = 3) -> DataFrame:
    """title, severity, refs as in joined(), after a last question over all batches' findings.

    The backend gets the drafts as JSON, of which joined() bounds the number, and answers with
    findings. One without references, or with fewer than the drafts of its title have, gets theirs.
    """
    drafts = joined(found, steps, most * 4, refs)
    asked = drafts.agg(F.to_json(F.sort_array(F.collect_list(F.struct("title", "severity", "refs")))).alias("context"), F.count("*").alias("n")).where("n > 0")
    answer = findings(context.infer(asked.withColumn("batch", F.lit("synthesis")), backend))
    from_drafts = drafts.select("title", "refs")
    cast = F.transform(F.coalesce("refs", F.array().cast(REFS)), lambda r: F.struct(r.getField("session_id").alias("session_id"), r.getField("start").alias("start"), F.coalesce(r.getField("end"), r.getField("start")).alias("end")))
    filled = refs_.back_fill(answer.select("title", "severity", cast.alias("refs")), from_drafts, "title", refs)
    # What the synthesis made up of unknown steps goes here.
    return joined(filled.withColumn("batch", F.lit("synthesis")), steps, most, refs)


RATIONALE = "array<struct<name:string,score:double,rationale:string>>"


def recommended(items: DataFrame, chosen: DataFrame, backend: Callable[[str], str], most: int = 10) -> DataFrame:
    """item_id, name, score, rationale of the candidates that a backend keeps, best first.

    chosen is what search.candidates() gives, a bounded list; the backend gets it as JSON with
    the items' descriptions and answers with names, scores and reasons. Of a name that occurs
    twice the first counts, and one that is no candidate's is left out.
    """
    asked = chosen.join(items.select("item_id", "description"), "item_id")
    one = asked.agg(F.to_json(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "name", "description")))).alias("context"), F.count("*").alias("n")).where("n > 0")
    answers = context.infer(one.withColumn("batch", F.lit("items")), backend)
    said = answers.where("ok").select(F.posexplode(F.from_json(fenced(F.col("answer")), RATIONALE)).alias("at", "r")).select("at", "r.*").where("name is not null")
    first = refs_.first_per_name(said, chosen, "name", [F.col("at")])
    known = refs_.first_per_name(chosen.withColumnRenamed("score", "base"), first, "name", [F.desc("base"), F.asc("item_id")])
    return first.join(known, "name").select("item_id", "name", F.coalesce("score", "base").alias("score"), "rationale").orderBy(F.desc("score"), "name").limit(most)


def analyse(contexts: DataFrame, sessions: DataFrame, steps: DataFrame, backend: Callable[[str], str], budget: int = 100_000, synthesis: bool = False) -> DataFrame:
    """joined() findings of a backend (a callable from text to text) over all contexts, or synthesised() ones where several batches were asked. Batches that fail are left out; if all fail that is an error."""
    sized = contexts.select("session_id", context.token_estimate(F.col("context")).alias("tokens")).join(sessions.select("session_id", "project", "created_at"), "session_id")
    answers = context.infer(prompts(contexts, context.pack(sized, budget)), backend).persist()
    if not answers.limit(1).isEmpty() and answers.where("ok").limit(1).isEmpty():
        raise RuntimeError("every batch failed: " + str(answers.select("error").first().error))
    if synthesis and answers.where("ok").limit(2).count() > 1:
        return synthesised(findings(answers), backend, steps)
    return joined(findings(answers), steps)
