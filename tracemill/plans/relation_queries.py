"""Queries over relations between sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.models import with_cost
from tracemill.operators import intervals, phases, refs, sessions, sets
from tracemill.plans.adapters import STEPS_SQL, sessions_of, steps, table
from tracemill.plans.session_queries import CALLS_SQL, COST_SQL, PHASE_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id AS session_id, user_id AS file FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY user_id, event_id) AS n FROM events) WHERE n = 1 AND value > 20")
def listed_sessions(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("session_id"), F.struct("user_id", "event_id").alias("file"), F.when(F.col("value") > 20, "x").alias("first_message"))
    return sessions.listed(rows).select(F.col("file.event_id").alias("session_id"), F.col("file.user_id").alias("file"))


@query("SELECT c_custkey AS session_id, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 OR c_custkey = 7 ORDER BY 1")
def ranked_ids_join(spark, d):
    r = table(spark, d, "customer").where("c_acctbal > 9000 or c_custkey = 7").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("rank"))
    return refs.ranked_join(r, "n_nationkey", table(spark, d, "nation")).select(F.col("c_custkey").alias("session_id"), F.col("n_name").alias("place"))


@query("""WITH RECURSIVE l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey - 1 END AS prev FROM orders),
c AS (SELECT id, id AS head FROM l WHERE prev IS NULL UNION ALL SELECT l.id, c.head FROM c JOIN l ON l.prev = c.id) SELECT id AS session_id, head FROM c""")
def linked_chains(spark, d):
    k = F.col("o_orderkey")
    return sessions.chains(table(spark, d, "orders").select(k.alias("session_id"), F.when(k % 50 != 0, k - 1).alias("prev_id")))


@query(f"""WITH {STEPS_SQL}, k AS (SELECT session_id || '-c' || (step_idx // 20) AS session_id, session_id AS parent_id, ts + INTERVAL 7 MINUTE AS created_at FROM st WHERE step_idx % 20 = 3)
SELECT k.session_id, max(st.step_idx) AS step_idx FROM k LEFT JOIN st ON st.session_id = k.parent_id AND st.ts <= k.created_at GROUP BY 1""")
def children_on_timeline(spark, d):
    s = steps(spark, d)
    kids = s.where("step_idx % 20 = 3").select(F.concat_ws("", "session_id", F.lit("-c"), F.floor(F.col("step_idx") / 20).cast("string")).alias("session_id"), F.col("session_id").alias("parent_id"), (F.col("ts") + F.expr("interval 7 minutes")).alias("created_at"), F.lit(None).cast("int").alias("spawn_step"))
    return sessions.place_children(kids, s)


#: A marker stands before the first step later than it and all markers before it.
@query(f"""WITH {STEPS_SQL}, s AS (SELECT session_id, step_idx, ts, row_number() OVER (PARTITION BY session_id ORDER BY step_idx) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM st),
m AS (SELECT session_id, step_idx // 25 AS k, row_number() OVER (PARTITION BY session_id ORDER BY step_idx) - 1 AS q, max(ts + INTERVAL 9 MINUTE) OVER (PARTITION BY session_id ORDER BY step_idx) AS late FROM st WHERE step_idx % 25 = 4),
b AS (SELECT m.session_id, k, q, coalesce(min(r) FILTER (WHERE ts > late), any_value(n)) AS before FROM m JOIN s USING (session_id) GROUP BY 1, 2, 3)
SELECT session_id, CAST(before + q AS BIGINT) AS place, 'marker' AS kind, CAST(k AS BIGINT) AS key FROM b
UNION ALL SELECT s.session_id, CAST(r + count(before) FILTER (WHERE before <= r) AS BIGINT), 'step', CAST(step_idx AS BIGINT) FROM s LEFT JOIN b ON s.session_id = b.session_id GROUP BY s.session_id, r, step_idx""")
def markers_on_timeline(spark, d):
    s = steps(spark, d)
    marks = s.where("step_idx % 25 = 4").select("session_id", F.floor(F.col("step_idx") / 25).alias("marker_idx"), (F.col("ts") + F.expr("interval 9 minutes")).alias("ts"))
    return sessions.interleave(s, marks)


@query(f"""WITH {COST_SQL} SELECT session_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, round(sum(cost_usd), 6) AS cost_usd, count(*) FILTER (WHERE source = 'agent') AS agent_steps, count(*) FILTER (WHERE tool_name = 'Read') AS reads FROM cu GROUP BY 1""")
def session_analytics(spark, d):
    a = sessions.analytics(with_cost(steps(spark, d)))
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).alias
    return a.select("session_id", "prompt_tokens", "cost_usd", at("steps_by_source", "agent")("agent_steps"), at("tool_counts", "Read")("reads"))


@query(f"WITH {STEPS_SQL} SELECT session_id, coalesce(arg_min(model, step_idx) FILTER (WHERE model NOT LIKE '<%'), 'unknown') AS model FROM st GROUP BY 1")
def session_models(spark, d):
    s = steps(spark, d)
    return sessions.session_model(s.select("session_id").distinct().withColumn("model", F.lit("<none>")), s)


@query(f"WITH {STEPS_SQL} SELECT coalesce(project, 'Unknown') AS project, count(*) AS sessions, CASE WHEN project IS NULL THEN 2 ELSE 0 END AS tier FROM se GROUP BY project")
def sessions_by_project(spark, d):
    return sessions.by_project(sessions_of(spark, d))


@query(f"WITH {COST_SQL} SELECT CAST(sum(prompt_tokens + cache_read_tokens + cache_write_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd), 6) AS cost_usd FROM cu")
def call_metrics(spark, d):
    return sessions.call_metrics(with_cost(steps(spark, d)))


@query("SELECT count(*) AS count, CAST(floor(avg(l_quantity)) AS BIGINT) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem")
def timing_summary(spark, d):
    return sessions.timing(table(spark, d, "lineitem"), "l_quantity")


@query(f"""WITH {PHASE_SQL}, an AS (SELECT session_id, step_idx AS anchor, lead(step_idx) OVER (PARTITION BY session_id ORDER BY step_idx) AS nx FROM st WHERE source = 'user')
SELECT ab.session_id, anchor, phase, greatest(start_idx, anchor + 1) AS start_idx, least(end_idx, coalesce(nx - 1, end_idx)) AS end_idx FROM ab JOIN an ON ab.session_id = an.session_id AND start_idx < coalesce(nx, 2147483647) AND end_idx > anchor""")
def phases_by_prompt(spark, d):
    s = steps(spark, d)
    seg = phases.absorbed(phases.segments(phases.windows(phases.step_counts(s))))
    return sessions.anchored_phases(seg, s.where("source = 'user'"))


@query(f"""WITH {COST_SQL}, rf AS (SELECT session_id, step_id AS a, step_idx FROM st WHERE step_idx % 30 = 2), rg AS (SELECT r.session_id, r.a AS ref_id, r.step_idx AS f, coalesce(s.step_idx, r.step_idx) AS l FROM rf r LEFT JOIN st s ON s.session_id = r.session_id AND s.step_idx = r.step_idx + 4)
SELECT ref_id, count(*) AS steps, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS seconds FROM rg JOIN cu ON cu.session_id = rg.session_id AND step_idx BETWEEN f AND l GROUP BY 1""")
def friction_cost(spark, d):
    s = steps(spark, d)
    start = s.where("step_idx % 30 = 2").select("session_id", F.col("step_id").alias("start_id"), F.col("step_id").alias("ref_id"), (F.col("step_idx") + 4).alias("step_idx"))
    ref = start.join(s.select("session_id", "step_idx", F.col("step_id").alias("end_id")), ["session_id", "step_idx"], "left").drop("step_idx")
    return refs.cost(refs.ranges(ref, s), s)


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WHERE p_name LIKE 'red%') WHERE n = 1")
def first_known_names(spark, d):
    p = table(spark, d, "part")
    return refs.first_per_name(p, p.where("p_name like 'red%'"), "p_name", [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "p_name")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_three_orders(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sets.top_by_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query(f"WITH {CALLS_SQL} SELECT c.session_id, c.call_id FROM c WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.session_id = c.session_id AND al.target_id = c.call_id)")
def calls_without_strong_edge(spark, d):
    from tracemill.operators import edges

    c = edges.numbered(steps(spark, d))
    strong = edges.read_before_write(c).unionByName(edges.search_then_read(c)).unionByName(edges.write_then_test(c)).unionByName(edges.multi_edit(c))
    return edges.roots(c, strong)


#: Of each order those that the same customer places on its day or in the 30 days after it.
@query("""WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS x FROM orders)
SELECT p.o_orderkey, r.o_orderkey AS near FROM o p JOIN o r ON p.o_custkey = r.o_custkey AND p.x BETWEEN r.x AND r.x + 30""")
def points_in_ranges(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("x"))
    ranges = o.select(F.col("o_orderkey").alias("near"), "o_custkey", F.col("x").alias("a"), (F.col("x") + 30).alias("b"))
    return intervals.points_in_ranges(o, ranges, "o_custkey", "x", "a", "b").select("o_orderkey", "near")


@query("SELECT kind, key, CAST(sum(n) AS BIGINT) AS sessions FROM (SELECT 'project' AS kind, '/p' || (o_custkey % 5) AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'agent', o_orderpriority, count(*) FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 2) GROUP BY 1, 2")
def reconciled_histograms(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.concat(F.lit("/p"), F.col("o_custkey") % 5).alias("project"), F.col("o_orderpriority").alias("agent"))
    parsed = o.where("session_id % 2 = 0")
    counted = parsed.groupBy(F.lit("project").alias("kind"), F.col("project").alias("key")).agg(F.count("*").alias("sessions"))
    return sessions.reconcile_histograms(counted, o, parsed)


@query(f"""WITH {STEPS_SQL}, rf AS (SELECT session_id, step_idx AS a, step_idx + (step_idx % 7) * 5 AS b FROM st WHERE step_idx % 11 = 1)
SELECT rf.session_id, a, b, x.step_id AS start_id, CASE WHEN a <> b THEN y.step_id END AS end_id FROM rf JOIN st x ON x.session_id = rf.session_id AND x.step_idx = a LEFT JOIN st y ON y.session_id = rf.session_id AND y.step_idx = b""")
def resolved_refs(spark, d):
    s = steps(spark, d)
    ids = s.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("step_idx", "step_id"))).alias("step_ids"))
    wanted = s.where("step_idx % 11 = 1").select("session_id", F.col("step_idx").alias("start"), (F.col("step_idx") + F.col("step_idx") % 7 * 5).cast("int").alias("end"))
    return refs.resolve(wanted, ids).select("session_id", F.col("start").alias("a"), F.col("end").alias("b"), "start_id", "end_id")


@query("""WITH f AS (SELECT o_custkey AS k, list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 2) AS r FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), p AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS pool FROM orders GROUP BY 1)
SELECT f.k, array_to_string(list_slice(CASE WHEN len(pool) > len(r) THEN pool ELSE r END, 1, 3), ',') AS refs FROM f JOIN p USING (k)""")
def back_filled_refs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    final = o.where("o % 3 = 0").groupBy("k").agg(F.slice(F.sort_array(F.collect_list("o")), 1, 2).alias("refs"))
    drafts = o.select("k", F.array("o").alias("refs"))
    return refs.back_fill(final, drafts, "k").select("k", F.array_join("refs", ",").alias("refs"))


@query("SELECT o_custkey AS k, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS kinds FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%') GROUP BY 1")
def known_kinds(spark, d):
    o = table(spark, d, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x.getField("o_orderpriority")).alias("kinds"))
    kept = o.where("o_orderpriority like '1%' or o_orderpriority like '5%'").select("o_orderpriority").distinct()
    return refs.keep_known(rows, "kinds", kept, "o_orderpriority").select("k", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH {STEPS_SQL} SELECT session_id, 'a' || CAST(step_id AS VARCHAR) AS agent_id, CAST(step_id AS VARCHAR) AS call_id, step_idx FROM st WHERE tool_name IS NOT NULL AND step_id % 9 = 0""")
def spawned_agents(spark, d):
    c = steps(spark, d).where("tool_name is not null").select("session_id", F.col("step_id").cast("string").alias("call_id"), "step_idx")
    said = F.when(F.col("call_id").cast("long") % 9 == 0, F.concat(F.lit("done, agentId: a"), "call_id", F.lit(" (see file)"))).otherwise(F.lit("done"))
    return sessions.spawned(c, c.select("session_id", "call_id", said.alias("content")))


@query("""WITH i AS (SELECT o_orderkey AS session_id, 'f' || (o_orderkey // 4) AS file, o_orderstatus AS model FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_orderkey AS session_id, 'f' || (o_orderkey // 4) AS file, o_orderpriority AS model FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT file, arg_min(model, session_id) AS m FROM p GROUP BY 1) SELECT i.session_id, i.file, coalesce(p.model, b.m, i.model) AS model FROM i LEFT JOIN p ON i.session_id = p.session_id LEFT JOIN b ON i.file = b.file""")
def upgraded_index(spark, d):
    o = table(spark, d, "orders").withColumn("file", F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 4).cast("string")))
    rows = lambda where, model: o.where(where).select(F.col("o_orderkey").alias("session_id"), "file", F.col(model).alias("model"))
    return sessions.upgraded(rows("o_orderkey % 2 = 0", "o_orderstatus"), rows("o_orderkey % 3 <> 0", "o_orderpriority"), ["model"])
