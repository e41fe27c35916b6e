"""Dashboard aggregates over a session rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions import times
from tracemill.functions.models import real_model

NO_PROJECT, UNKNOWN = "(no project)", "unknown"


def session_days(steps: DataFrame) -> DataFrame:
    """session_id, day, messages, tokens, cost_usd: the daily breakdown of each session.

    A step without a time counts on the day of the session's first timed step. Steps are
    summed by day first, so that only sums are shuffled.
    """
    timed = F.when(F.col("ts").isNotNull(), F.struct("step_idx", "ts"))
    g = steps.groupBy("session_id", F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(
        F.count("*").alias("messages"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.min(timed).alias("first")
    )
    began = F.date_format(F.min("first").over(W.partitionBy("session_id")).getField("ts"), "yyyy-MM-dd")
    g = g.withColumn("day", F.coalesce("d", began))
    return g.groupBy("session_id", "day").agg(*[F.sum(c).alias(c) for c in ("messages", "tokens", "cost_usd")])


def rollup(steps: DataFrame) -> DataFrame:
    """One row for each session, from its steps with cost_usd: counts, token sums, cost, model, start, end, seconds.

    Start and end are the first and last known time by position, the model is the first
    real one by position, seconds are the span of all times cut to whole numbers.
    """
    at = lambda c, cond, least=True: (F.min_by if least else F.max_by)(c, F.when(cond, F.col("step_idx")))
    timed = F.col("ts").isNotNull()
    return steps.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.count("tool_name").alias("tool_calls"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens", "cost_usd")],
        F.coalesce(at("model", real_model(F.col("model"))), F.lit(UNKNOWN)).alias("model"),
        at("canonical_model", real_model(F.col("model"))).alias("canonical_model"),
        at("ts", timed).alias("created_at"),
        at("ts", timed, False).alias("updated_at"),
        F.coalesce(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")), F.lit(0)).cast("long").alias("duration"),
    )


def spread_totals(totals: DataFrame, steps: DataFrame) -> DataFrame:
    """session_id, day, messages, tokens, cost_usd: a session's totals dealt over its days by their timed messages; tokens are cut to whole numbers.

    For sources that know totals only. totals has session_id, tokens, cost_usd.
    """
    n = steps.where("ts is not null").groupBy("session_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("messages"))
    part = F.col("messages") / F.sum("messages").over(W.partitionBy("session_id")).cast("double")
    shared = n.withColumn("part", part).join(totals, "session_id")
    return shared.select("session_id", "day", "messages", F.floor(F.col("tokens") * F.col("part")).alias("tokens"), (F.col("cost_usd") * F.col("part")).alias("cost_usd"))


def metadata_filter(rows: DataFrame, project: str | None = None, date_from: str | None = None, date_to: str | None = None, agent: str | None = None) -> DataFrame:
    """Equality on project and agent, inclusive range of days; rows without a time go only where a day bound is given."""
    out = rows
    day = F.date_format("created_at", "yyyy-MM-dd")
    for cond in ([F.col("project") == project] if project is not None else []) + ([F.col("agent") == agent] if agent is not None else []) + ([day >= date_from] if date_from else []) + ([day <= date_to] if date_to else []):
        out = out.where(cond)
    return out


def totals(r: DataFrame) -> DataFrame:
    """Grand totals and averages; averages of no session are 0."""
    n = F.greatest(F.count("*"), F.lit(1)).cast("double")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    tokens = s(F.col("prompt_tokens") + F.col("completion_tokens"))
    return r.agg(
        F.count("*").alias("sessions"),
        s("messages").alias("messages"),
        s("tool_calls").alias("tool_calls"),
        tokens.alias("tokens"),
        F.round(s("duration") / 3600.0, 2).alias("hours"),
        F.round(s("cost_usd"), 6).alias("cost_usd"),
        F.round(s("messages") / n, 1).alias("avg_messages"),
        F.round(s("tool_calls") / n, 1).alias("avg_tool_calls"),
        F.round(tokens / n, 0).alias("avg_tokens"),
        F.round(s("duration") / n, 0).alias("avg_duration"),
        F.countDistinct(F.coalesce("project", F.lit(None))).alias("projects"),
    )


def daily(r: DataFrame, days: DataFrame) -> DataFrame:
    """day, messages, tokens, cost_usd by the day of the steps; session_count, duration by the day a session began."""
    by_step = days.where("day is not null").groupBy("day").agg(F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost"))
    by_start = r.where("created_at is not null").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("session_count"), F.sum("duration").alias("duration"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return by_step.join(by_start, "day", "full").select("day", z("messages"), z("tokens"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost_usd"), z("session_count"), z("duration"))


def periods(r: DataFrame, days: DataFrame, now: str) -> DataFrame:
    """period (year, month, week), sessions and tool calls by start day, messages and tokens by step day, from each period's first day on."""
    start = {p: F.date_format(F.date_trunc(p, F.to_timestamp(F.lit(now))), "yyyy-MM-dd") for p in ("year", "month", "week")}
    began = F.date_format("created_at", "yyyy-MM-dd")
    a = r.select(began.alias("day"), F.lit(1).alias("sessions"), "tool_calls", "duration", F.lit(0).alias("messages"), F.lit(0).alias("tokens"))
    b = days.select("day", F.lit(0).alias("sessions"), F.lit(0).alias("tool_calls"), F.lit(0).alias("duration"), "messages", "tokens")
    names = ("sessions", "tool_calls", "duration", "messages", "tokens")
    both = a.unionByName(b)
    marked = both.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), s.alias("start")) for p, s in start.items()])).alias("p")).where("day >= p.start")
    return marked.groupBy(F.col("p.period").alias("period")).agg(*[F.sum(c).cast("long").alias(c) for c in names])


def histogram(r: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return r.groupBy(key.alias(name)).agg(F.count("*").alias("sessions"))


def histograms(r: DataFrame) -> DataFrame:
    """kind, key, sessions: sessions by model, project, agent and start day, by one pass."""
    keys = {"model": F.coalesce("model", F.lit(UNKNOWN)), "project": F.coalesce("project", F.lit(NO_PROJECT)), "agent": F.col("agent"), "day": F.date_format("created_at", "yyyy-MM-dd")}
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()])).alias("e")
    return r.select(e).where("e.key is not null").groupBy("e.kind", "e.key").agg(F.count("*").alias("sessions"))


def hours(r: DataFrame) -> DataFrame:
    """weekday (Monday 0), hour, sessions."""
    t = r.where("created_at is not null")
    return t.groupBy(F.weekday("created_at").cast("long").alias("weekday"), F.hour("created_at").cast("long").alias("hour")).agg(F.count("*").alias("sessions"))


def project_details(r: DataFrame) -> DataFrame:
    return r.groupBy(F.coalesce("project", F.lit(NO_PROJECT)).alias("project")).agg(
        F.count("*").alias("sessions"), F.sum("messages").alias("messages"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd")
    )


def cost_by_model(r: DataFrame) -> DataFrame:
    """Cost by canonical or else raw name, of sessions that cost something."""
    return r.where("cost_usd > 0").groupBy(F.coalesce("canonical_model", "model").alias("model")).agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def fill_days(d: DataFrame, values: list[str]) -> DataFrame:
    """Rows of zeros for the days between the first and the last that have none."""
    span = d.agg(F.min(F.to_date("day")).alias("a"), F.max(F.to_date("day")).alias("b")).where("a is not null")
    all_days = span.select(F.explode(F.sequence("a", "b")).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return all_days.join(d.select("day", *values), "day", "left").select("day", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def by_month(d: DataFrame, values: list[str]) -> DataFrame:
    return d.groupBy(F.substring("day", 1, 7).alias("month")).agg(*[F.sum(v).alias(v) for v in values])


def heat_level(d: DataFrame, value: str) -> DataFrame:
    """Level 0 to 4 of each day by the logarithm of its value over that of the largest one."""
    top = d.agg(F.max(value).alias("top"))
    share = F.log1p(value) / F.log1p("top")
    level = F.when(F.col(value) <= 0, 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)
    return d.join(F.broadcast(top)).select("day", value, level.alias("level"))


def top_and_other(t: DataFrame, key: str, value: str, keep: int) -> DataFrame:
    """The `keep` keys of highest value and the sum of the rest as `other`. The cut is found by a bounded top list."""
    top = t.groupBy(key).agg(F.sum(value).alias("v")).orderBy(F.desc("v"), key).limit(keep).select(key)
    flagged = t.join(F.broadcast(top.withColumn("top", F.lit(True))), key, "left")
    return flagged.groupBy(F.when(F.col("top"), F.col(key)).otherwise("other").alias(key)).agg(F.sum(value).alias(value))


def share(t: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's part of the total."""
    total = t.agg(F.sum(value).alias("total"))
    return t.join(F.broadcast(total)).select(key, value, F.round(F.col(value) / F.nullif(F.col("total"), F.lit(0)).cast("double"), 4).alias("share"))


def final_metrics(steps: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row for each session when it is read: token sums, cost (null where nothing has a price), steps, tool calls, seconds, and messages, tokens and cost by day.

    steps has cost_usd, as with_cost() writes it. A step without a time counts for the day of
    the session's first timed step; without any there are no days. calls are counted, or else
    the steps that have a tool_name.
    """
    first = steps.where("ts is not null").groupBy("session_id").agg(F.min_by("ts", "step_idx").alias("__first"))
    s = steps.join(first, "session_id", "left").withColumn("day", times.day(F.coalesce("ts", "__first")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    spent = zero(F.col("prompt_tokens")) + zero(F.col("completion_tokens"))
    days = s.where("day is not null").groupBy("session_id", "day").agg(F.count("*").alias("messages"), F.sum(spent).alias("tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    by_day = days.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", F.struct("messages", "tokens", "cost_usd"))))).alias("days"))
    sums = {c: zero(F.sum(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")}
    own = F.count("tool_name") if calls is None else F.lit(0)
    out = steps.groupBy("session_id").agg(*sums.values(), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count("*").alias("steps"), own.alias("tool_calls"), F.coalesce(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")), F.lit(0)).alias("duration"))
    if calls is not None:
        n = calls.groupBy("session_id").agg(F.count("*").alias("__n"))
        out = out.join(n, "session_id", "left").withColumn("tool_calls", zero(F.col("__n"))).drop("__n")
    return out.join(by_day, "session_id", "left")


def detail_counts(steps: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """key, sessions, steps: what each group of sessions, such as an upload, holds."""
    n = steps.groupBy("session_id").agg(F.count("*").alias("n"))
    return sessions.join(n, "session_id", "left").groupBy(key).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("steps"))
