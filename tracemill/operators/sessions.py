"""Sessions in relation to each other: families, spawned sub-agents, chains, and what is placed on a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.durable import checkpointed
from tracemill.functions.models import real_model
from tracemill.operators import sets


def listed(sessions: DataFrame) -> DataFrame:
    """The first row of each session id by file, and of these those with a first message: a later file does not stand in for one that is empty."""
    return sets.first_by(sessions, ["session_id"], [F.col("file")]).where("first_message is not null and first_message <> ''")


def visible(own: DataFrame, examples: DataFrame, token: str | None) -> DataFrame:
    """A user's own sessions, those that belong to nobody, and the examples; own ones win."""
    mine = own.where(F.col("token").isNull() | (F.col("token") == token) if token else F.col("token").isNull())
    return sets.union_first_wins([mine, examples], ["session_id"], [F.col("session_id")])


def with_children(sessions: DataFrame, root: str) -> DataFrame:
    """A session and its children: itself first, then by start, those without one first."""
    rows = sessions.where((F.col("session_id") == root) | (F.col("parent_id") == root))
    return rows.withColumn("is_child", F.col("session_id") != root).orderBy("is_child", F.asc_nulls_first("created_at"), "session_id")


def spawned(calls: DataFrame, results: DataFrame, pattern: str = "agentId: ([A-Za-z0-9_-]+)") -> DataFrame:
    """session_id, agent_id, call_id, step_idx: which call started a sub-agent, by the id that its result names."""
    named = results.select("session_id", "call_id", F.nullif(F.regexp_extract("content", pattern, 1), F.lit("")).alias("agent_id")).where("agent_id is not null")
    return named.join(calls.select("session_id", "call_id", "step_idx"), ["session_id", "call_id"]).select("session_id", "agent_id", "call_id", "step_idx")


def unmatched_agents(named: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agents that a result names but no file holds, and files that no result names; compactions need no result."""
    a, b = named.select("agent_id").distinct(), found.select("agent_id", "is_compaction")
    return a.join(b, "agent_id", "left_anti"), b.where("not is_compaction").join(a, "agent_id", "left_anti").select("agent_id")


def fill_links(index: DataFrame, parsed: DataFrame) -> DataFrame:
    """index with prev_id and next_id from parsed where it lacks them."""
    p = parsed.select("session_id", F.col("prev_id").alias("p"), F.col("next_id").alias("n"))
    return index.join(p, "session_id", "left").withColumn("prev_id", F.coalesce("prev_id", "p")).withColumn("next_id", F.coalesce("next_id", "n")).drop("p", "n")


def continuations(lines: DataFrame) -> DataFrame:
    """session_id, prev_id, next_id: a file that holds lines of a second session continues it. lines has file, session_id, pos."""
    n = lines.where("session_id is not null").groupBy("file", "session_id").agg(F.min("pos").alias("pos"))
    two = n.withColumn("k", F.row_number().over(W.partitionBy("file").orderBy("pos")))
    back = two.where("k = 1").select("file", F.col("session_id").alias("prev_id")).join(two.where("k = 2").select("file", "session_id"), "file").select("session_id", "prev_id").distinct()
    ahead = back.select(F.col("prev_id").alias("session_id"), F.col("session_id").alias("next_id"))
    return back.join(ahead, "session_id", "full")


def chains(links: DataFrame, rounds: int = 20) -> DataFrame:
    """session_id, head: the first session of each one's chain, by doubling; links has session_id, prev_id.

    rounds of doubling reach over two to that power sessions. Sessions of a loop are their own heads.
    """
    p = links.select("session_id", F.coalesce("prev_id", "session_id").alias("head"))
    roots = p.where("session_id = head").select(F.col("session_id").alias("root"))
    for _ in range(rounds):
        step = p.select(F.col("session_id").alias("head"), F.col("head").alias("next"))
        q = p.join(step, "head", "left").select("session_id", F.coalesce("next", "head").alias("head"))
        q = checkpointed(q)
        if q.join(p.withColumnRenamed("head", "old"), "session_id").where("head <> old").isEmpty():
            break
        p = q
    known = p.join(roots, F.col("head") == F.col("root"), "left_semi")
    return known.unionByName(p.join(roots, F.col("head") == F.col("root"), "left_anti").select("session_id", F.col("session_id").alias("head")))


def owned(skeletons: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows whose file the same reader still finds; files has session_id and agent."""
    return skeletons.join(files.select("session_id", "agent"), ["session_id", "agent"], "left_semi")


def upgraded(skeletons: DataFrame, parsed: DataFrame, columns: list[str]) -> DataFrame:
    """Index rows with what a full reading knows: by id, or else the first session of the row's file, or else as they were."""
    cols = F.struct(*columns)
    by_id = parsed.groupBy("session_id").agg(F.min_by(cols, "file").alias("__a"))
    by_file = parsed.groupBy("file").agg(F.min_by(cols, "session_id").alias("__b"))
    j = skeletons.join(by_id, "session_id", "left").join(by_file, "file", "left")
    return j.select(*[F.when(F.col("__a").isNotNull(), F.col(f"__a.{c}")).when(F.col("__b").isNotNull(), F.col(f"__b.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in skeletons.columns])


#: What an index of sessions does not need and what makes it large.
HEAVY = ("tool_definitions", "system_prompt")


def light(sessions: DataFrame, nested: str | None = None) -> DataFrame:
    """sessions without heavy columns, or without heavy fields of the struct column named."""
    if nested is None:
        return sessions.drop(*HEAVY)
    return sessions.withColumn(nested, F.col(nested).dropFields(*[h for h in HEAVY if h in sessions.schema[nested].dataType.names]))


def place_children(children: DataFrame, steps: DataFrame) -> DataFrame:
    """session_id, step_idx: the step of the parent at which a child stands.

    The step that spawned it, or else the last timed step at or before its start that comes
    before any later one; null if there is none.
    """
    k = children.select("session_id", F.col("parent_id").alias("p"), "created_at", "spawn_step")
    # Before any later step means: the latest time up to the step is not past the child's start.
    # That time never falls along the steps, so children take their places among the steps by one sort.
    so_far = F.max("ts").over(W.partitionBy("p").orderBy("step_idx").rowsBetween(W.unboundedPreceding, 0))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {f.name: f.dataType.simpleString() for f in children.schema.fields}
    s = steps.where("ts is not null").select(F.col("session_id").alias("p"), "step_idx", "ts").select("p", so_far.alias("at"), F.lit(0).alias("kind"), "step_idx", none(kinds["session_id"]).alias("session_id"))
    c = k.where("spawn_step is null and created_at is not null").select("p", F.col("created_at").alias("at"), F.lit(1).alias("kind"), none(dict(steps.dtypes)["step_idx"]).alias("step_idx"), "session_id")
    before = W.partitionBy("p").orderBy("at", "kind", "step_idx").rowsBetween(W.unboundedPreceding, 0)
    found = s.unionByName(c).withColumn("found", F.last("step_idx", ignorenulls=True).over(before)).where("kind = 1").groupBy("session_id").agg(F.max("found").alias("found"))
    return k.join(found, "session_id", "left").select("session_id", F.coalesce("spawn_step", "found").alias("step_idx"))


def interleave(steps: DataFrame, markers: DataFrame) -> DataFrame:
    """session_id, place, kind, key: steps in order with markers before the first step later than them.

    Markers keep their own order; one without a time, or a step without one, lets none pass;
    those left over come last. The latest time among the markers up to each, and among the
    steps up to each, put both into one order, so that a long session is sorted, not held.
    """
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    so_far = lambda key: W.partitionBy("session_id").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    s = steps.select("session_id", F.coalesce(F.max(us).over(so_far("step_idx")), low).alias("at"), F.lit("step").alias("kind"), F.col("step_idx").cast("long").alias("key"))
    m = markers.select("session_id", F.max(F.coalesce(us, high)).over(so_far("marker_idx")).alias("at"), F.lit("marker").alias("kind"), F.col("marker_idx").cast("long").alias("key"))
    order = W.partitionBy("session_id").orderBy("at", F.desc("kind"), "key")
    return s.unionByName(m).select("session_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "kind", "key")


def analytics(steps: DataFrame) -> DataFrame:
    """One row for each session: tokens by kind, steps by source and calls by tool as maps, cost by price alone (null where nothing has a price)."""
    tokens = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")}
    base = steps.groupBy("session_id").agg(*tokens.values(), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    count = lambda c, name: steps.where(F.col(c).isNotNull()).groupBy("session_id", c).agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(name))
    return base.join(count("source", "steps_by_source"), "session_id", "left").join(count("tool_name", "tool_counts"), "session_id", "left")


def session_model(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """session_id, model: the session's own if real, else the first real one of its steps, else unknown."""
    first = steps.where(real_model(F.col("model"))).groupBy("session_id").agg(F.min_by("model", "step_idx").alias("m"))
    return sessions.join(first, "session_id", "left").select("session_id", F.coalesce(F.when(real_model(F.col("model")), F.col("model")), "m", F.lit("unknown")).alias("model"))


def by_project(sessions: DataFrame) -> DataFrame:
    """project, sessions, tier: real folders first, then hidden ones, then sessions without one."""
    g = sessions.groupBy(F.coalesce("project", F.lit("Unknown")).alias("project")).agg(F.count("*").alias("sessions"))
    tier = F.when(F.col("project") == "Unknown", 2).when(F.regexp_like("project", F.lit("(?:^|/)\\.[^/]*$")), 1).otherwise(0)
    return g.withColumn("tier", tier).orderBy("tier", F.desc("sessions"), "project")


def call_metrics(rows: DataFrame) -> DataFrame:
    """Totals over language-model calls; prompt counts what was read from and written to the cache, and zero counts as unknown."""
    prompt = F.sum("prompt_tokens") + F.sum("cache_read_tokens") + F.sum("cache_write_tokens")
    return rows.agg(F.nullif(prompt, F.lit(0)).alias("prompt_tokens"), F.nullif(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def timing(rows: DataFrame, value: str) -> DataFrame:
    """count, mean (whole), least, most and the 95th percentile by rank."""
    p = F.percentile_approx(value, 0.95, 1_000_000)
    return rows.agg(F.count(value).alias("count"), F.floor(F.avg(value)).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), p.alias("p95"))


def reconcile_histograms(stats: DataFrame, sessions: DataFrame, parsed: DataFrame) -> DataFrame:
    """kind, key, sessions with the sessions that are listed but not parsed added to the project and agent counts."""
    extra = sessions.join(parsed.select("session_id"), "session_id", "left_anti")
    e = F.explode(F.array(F.struct(F.lit("project").alias("kind"), F.coalesce("project", F.lit("(no project)")).alias("key")), F.struct(F.lit("agent").alias("kind"), F.col("agent").alias("key")))).alias("e")
    more = extra.select(e).groupBy("e.kind", "e.key").agg(F.count("*").alias("sessions"))
    return stats.unionByName(more).groupBy("kind", "key").agg(F.sum("sessions").alias("sessions"))


def anchored_phases(segments: DataFrame, anchors: DataFrame, bucket: int = 64) -> DataFrame:
    """session_id, anchor, phase, start_idx, end_idx: segments cut at users' messages and given to the last one at or before them.

    Both are dealt over buckets of positions; a pair is reported in the bucket in which the later of the two begins.
    """
    a = anchors.select("session_id", F.col("step_idx").alias("anchor"), F.lead("step_idx").over(W.partitionBy("session_id").orderBy("step_idx")).alias("next"))
    last = segments.groupBy("session_id").agg(F.max("end_idx").alias("last"))
    places = lambda x, y: F.explode(F.sequence(F.floor(x / bucket), F.floor(y / bucket))).alias("b")
    a = a.join(last, "session_id").where("anchor < last").select("session_id", "anchor", "next", places(F.col("anchor"), F.coalesce("next", "last")))
    s = segments.select("session_id", "phase", "start_idx", "end_idx", places(F.col("start_idx"), F.col("end_idx")))
    j = s.join(a, ["session_id", "b"]).where("start_idx < coalesce(next, 2147483647) and end_idx > anchor").where(F.floor(F.greatest("start_idx", "anchor") / bucket) == F.col("b"))
    return j.select("session_id", "anchor", "phase", F.greatest("start_idx", F.col("anchor") + 1).alias("start_idx"), F.least("end_idx", F.coalesce(F.col("next") - 1, F.col("end_idx"))).alias("end_idx"))
