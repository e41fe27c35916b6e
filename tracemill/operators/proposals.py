"""Proposals by a language model in two steps: batches of sessions are asked for ideas, then each idea is asked about with the sessions that it cites. New texts come of it, or edits of texts that are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions.text import fenced, without_part
from tracemill.operators import context, packing, report

PROPOSALS = "array<struct<name:string,description:string,rationale:string,confidence:double,session_ids:array<string>>>"
EDITS = "array<struct<old:string,new:string>>"
#: Contexts that go into one question, whatever room there is.
CITED = 1000


def edited(text: Column, edits: Column) -> Column:
    """text, applied and refused of a text and an array of edits with old and new, one after another.

    An edit replaces its old text, which has to occur exactly once in the text as it then is,
    overlapping occurrences counted; an empty or missing old text appends the new one. Others are
    refused and change nothing. A missing text is empty, missing edits are none.
    """
    kind = f"struct<text:string,applied:int,refused:{EDITS}>"
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("applied"), F.array().cast(EDITS).alias("refused")).cast(kind)

    def step(s: Column, e: Column) -> Column:
        now, old, new = s.getField("text"), F.coalesce(e.getField("old"), F.lit("")), F.coalesce(e.getField("new"), F.lit(""))
        at = F.call_function("locate", old, now)
        once = (at > 0) & (F.call_function("locate", old, now, at + 1) == 0)
        done = lambda t: F.struct(t.alias("text"), (s.getField("applied") + 1).alias("applied"), s.getField("refused").alias("refused")).cast(kind)
        refused = F.struct(now.alias("text"), s.getField("applied").alias("applied"), F.concat(s.getField("refused"), F.array(F.struct(old.alias("old"), new.alias("new")))).alias("refused")).cast(kind)
        replaced = F.concat(F.substring(now, F.lit(1), at - 1), new, F.substring(now, at + F.length(old), F.length(now)))
        return F.when(e.isNull(), s).when(old == "", done(F.concat(now, new))).when(once, done(replaced)).otherwise(refused)

    return F.aggregate(F.coalesce(edits, F.array().cast(EDITS)), start, step)


def proposed(answers: DataFrame) -> DataFrame:
    """batch, place, name, description, rationale, confidence (0 to 1), session_ids of each proposal with a name in the answers; an answer that is no such JSON gives none."""
    p = answers.where("ok").select("batch", F.posexplode(F.from_json(fenced(F.col("answer")), PROPOSALS)).alias("place", "p")).where("trim(p.name) <> ''")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p.confidence", F.lit(0.0))))
    return p.select("batch", "place", F.trim("p.name").alias("name"), "p.description", "p.rationale", sure.alias("confidence"), "p.session_ids")


def merged(found: DataFrame, most: int = 10, known: DataFrame | None = None) -> DataFrame:
    """name, description, rationale, confidence: of several proposals of one name the surest, the `most` surest names. Names that are not in `known`, if given, were made up and go."""
    rows = found if known is None else found.join(known.select("name"), "name", "left_semi")
    first = F.struct(-F.col("confidence"), "batch", "place")
    best = rows.groupBy("name").agg(F.min_by(F.struct("description", "rationale", "confidence"), first).alias("p"))
    return best.select("name", "p.*").orderBy(F.desc("confidence"), "name").limit(most)


def questions(chosen: DataFrame, found: DataFrame, contexts: DataFrame, budget: int, extra: str | None = None) -> DataFrame:
    """chosen with `context`: the proposal as JSON and the contexts of the sessions that proposals of its name cite, by id, as many as fit the budget.

    Parts of a session count for it. A proposal that cites no session which is there gets the
    first contexts of all. extra names a column of chosen that goes between the two. At most
    CITED contexts go into a question, which the first ones of each partition decide before the shuffle.
    """
    texts = contexts.select(F.col("session_id").cast("string").alias("part"), "context", context.token_estimate(F.col("context")).alias("tokens")).where("tokens <= " + str(int(budget)))
    texts = texts.withColumn("session_id", without_part(F.col("part")))
    cited = found.join(chosen.select("name"), "name", "left_semi").select("name", F.explode("session_ids").alias("s")).select("name", without_part(F.col("s")).alias("session_id")).distinct()
    rows = cited.join(texts, "session_id")
    by_id = W.partitionBy("name").orderBy("session_id", "part")
    rows = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= CITED)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "part", "context"))), lambda x: x.getField("context")), "\n\n").alias(c)
    own = rows.withColumn("sum", F.sum("tokens").over(by_id)).where(F.col("sum") <= budget).groupBy("name").agg(in_order("own"))
    # One row: the first contexts of all, CITED at most, so the window has a bounded input.
    first = texts.orderBy("session_id", "part").limit(CITED)
    first = first.withColumn("sum", F.sum("tokens").over(W.orderBy("session_id", "part"))).where(F.col("sum") <= budget).agg(in_order("any"))
    head = F.to_json(F.struct("name", "description", "rationale"))
    joined = chosen.join(own, "name", "left").join(F.broadcast(first))
    parts = [head, *([F.col(extra)] if extra else []), F.coalesce("own", "any")]
    return joined.withColumn("context", F.concat_ws("\n\n", *parts)).drop("own", "any")


def _ideas(contexts: DataFrame, sessions: DataFrame, propose: Callable[[str], str], budget: int) -> DataFrame:
    sized = contexts.select("session_id", context.token_estimate(F.col("context")).alias("tokens")).join(sessions.select("session_id", "project", "created_at"), "session_id")
    answers = context.infer(report.prompts(contexts, packing.pack_by_affinity(sized, budget)), propose).persist()
    if not answers.limit(1).isEmpty() and answers.where("ok").limit(1).isEmpty():
        raise RuntimeError("every batch failed: " + str(answers.select("error").first().error))
    return proposed(answers)


def create(contexts: DataFrame, sessions: DataFrame, propose: Callable[[str], str], write: Callable[[str], str], budget: int = 100_000, most: int = 10) -> DataFrame:
    """name, description, rationale, confidence, ok, content, error of new texts: propose is asked for each batch of contexts, write for each proposal.

    Both go from text to text and run in tasks. propose answers with PROPOSALS as JSON, write
    with the text itself. A batch that fails is left out, an error if all do; a text that fails
    is a row with its error.
    """
    found = _ideas(contexts, sessions, propose, budget)
    asked = context.infer(questions(merged(found, most), found, contexts, budget), write)
    return asked.select("name", "description", "rationale", "confidence", "ok", fenced(F.col("answer")).alias("content"), "error")


def evolve(contexts: DataFrame, sessions: DataFrame, installed: DataFrame, propose: Callable[[str], str], write: Callable[[str], str], budget: int = 100_000, most: int = 10) -> DataFrame:
    """name, rationale, confidence, ok, text, applied, refused, error of changed texts; as create(), but of the texts in `installed` (name, text).

    write gets the text between proposal and contexts and answers with EDITS as JSON, which go
    through edited(). ok is false where there is no such answer; text is then what it was.
    """
    one = installed.groupBy("name").agg(F.min("text").alias("text"))
    found = _ideas(contexts, sessions, propose, budget)
    chosen = merged(found, most, one).join(one, "name")
    asked = context.infer(questions(chosen, found, contexts, budget, "text"), write)
    edits = F.from_json(fenced(F.col("answer")), EDITS)
    asked = asked.withColumn("edits", edits).withColumn("r", edited(F.col("text"), F.col("edits")))
    fine = F.col("ok") & F.col("edits").isNotNull()
    return asked.select("name", "rationale", "confidence", fine.alias("ok"), "r.text", "r.applied", "r.refused", F.coalesce("error", F.when(~fine, F.lit("no edits in the answer"))).alias("error"))
