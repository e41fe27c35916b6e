"""Queries over the session model itself: calls with their results, families, links between files, stores in order, and texts of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import model, sinks
from tracemill.functions import text, times, tools
from tracemill.operators import context, dashboard, report, sessions, sets
from tracemill.plans.adapters import STEPS_SQL, sessions_of, steps, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _logs(spark, d) -> model.Parsed:
    """Suppliers as sessions, their orders as steps, lines as calls; every line that was accepted or returned is a result."""
    lines = table(spark, d, "lineitem")
    id_, step = F.col("l_suppkey").cast("string").alias("session_id"), F.col("l_orderkey").cast("int").alias("step_idx")
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    calls = lines.groupBy(id_, step, F.col("l_linenumber").alias("call_pos"), F.when(F.col("l_linenumber") != 7, name).otherwise("").alias("call_id")).agg(F.min("l_partkey").alias("part"))
    calls = calls.withColumn("tool_name", F.concat(F.lit("tool"), F.col("part") % 9)).withColumn("arguments", F.to_json(F.struct("part")))
    results = lines.where("l_returnflag <> 'N'").select(id_, name.alias("call_id"), F.col("l_linestatus").alias("content"), (F.col("l_returnflag") == "R").alias("is_error"))
    found = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("session_id"))
    return model.Parsed(model.conform(found, model.SESSIONS), model.conform(lines.select(id_, step).distinct(), model.STEPS), model.conform(calls, model.CALLS), model.conform(results, model.RESULTS))


LOGS_SQL = """
ca AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, CAST(l_orderkey AS INTEGER) AS step_idx, l_linenumber AS call_pos, CASE WHEN l_linenumber <> 7 THEN l_orderkey || '-' || l_linenumber ELSE '' END AS call_id,
  'tool' || (min(l_partkey) % 9) AS tool_name FROM lineitem GROUP BY 1, 2, 3, 4),
re AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, l_orderkey || '-' || l_linenumber AS call_id, bool_or(l_returnflag = 'R') AS is_error FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)"""


@query(f"""WITH {LOGS_SQL} SELECT session_id, step_idx, CAST(row_number() OVER (PARTITION BY session_id ORDER BY step_idx, call_pos) - 1 AS INTEGER) AS idx, call_id, tool_name, coalesce(is_error, false) AS is_error
FROM ca LEFT JOIN re USING (session_id, call_id) WHERE call_id <> ''""")
def calls_with_results(spark, d):
    return _logs(spark, d).flat_calls().drop("arguments")


@query(f"""WITH {LOGS_SQL}, n AS (SELECT session_id, count(*) AS calls, count(DISTINCT step_idx) AS steps, count(re.call_id) AS answered FROM ca LEFT JOIN re USING (session_id, call_id) GROUP BY 1)
SELECT session_id, steps, calls, answered FROM n""")
def nested_and_back(spark, d):
    p = model.unnest(_logs(spark, d).nested())
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    return count(p.steps, "steps").join(count(p.calls, "calls"), "session_id").join(count(p.results, "answered"), "session_id", "left").withColumn("answered", F.coalesce("answered", F.lit(0)))


@query("""WITH id AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS session_id FROM supplier),
st AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, l_orderkey % 5000 AS step_id FROM lineitem), ca AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, l_partkey % 997 AS call_id FROM lineitem WHERE l_returnflag <> 'N'),
re AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, l_partkey % 997 AS call_id FROM lineitem WHERE l_linenumber <> 1)
SELECT 'unsafe id' AS rule, 'error' AS severity, session_id FROM id WHERE contains(session_id, '#')
UNION SELECT 'repeated step id', 'error', session_id FROM st GROUP BY session_id, step_id HAVING count(*) > 1
UNION SELECT 'repeated call id', 'warning', session_id FROM ca GROUP BY session_id, call_id HAVING count(*) > 1
UNION SELECT 'result without call', 'error', session_id FROM re ANTI JOIN ca USING (session_id, call_id)
UNION SELECT 'call without result', 'warning', session_id FROM ca ANTI JOIN re USING (session_id, call_id)""")
def broken_rules(spark, d):
    lines = table(spark, d, "lineitem").withColumn("session_id", F.col("l_suppkey").cast("string")).withColumn("call_id", (F.col("l_partkey") % 997).cast("string"))
    found = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.col("s_suppkey").cast("string")).alias("session_id"))
    said = lines.select("session_id", (F.col("l_orderkey") % 5000).alias("step_id"))
    return model.violations(model.Parsed(found, said, lines.where("l_returnflag <> 'N'"), lines.where("l_linenumber <> 1")))


@query("""WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 AND c_custkey >= 4 THEN c_custkey // 4 END AS parent FROM customer),
f AS (SELECT id AS root, id, 0 AS depth FROM s WHERE parent IS NULL UNION ALL SELECT f.root, s.id, f.depth + 1 FROM f JOIN s ON s.parent = f.id) SELECT root, id AS session_id, depth FROM f""")
def session_families(spark, d):
    id_ = F.col("c_custkey")
    return model.family(table(spark, d, "customer").select(id_.alias("session_id"), F.when((id_ % 10 != 0) & (id_ >= 4), F.floor(id_ / 4)).alias("parent_id")))


@query("""WITH a AS (SELECT DISTINCT o_custkey * 2 AS agent_id FROM orders WHERE o_orderkey % 20 = 0), b AS (SELECT c_custkey AS agent_id, c_nationkey = 3 AS is_compaction FROM customer)
SELECT 'no file' AS kind, agent_id FROM a ANTI JOIN b USING (agent_id) UNION ALL SELECT 'not named', agent_id FROM b ANTI JOIN a USING (agent_id) WHERE NOT is_compaction""")
def unmatched_agents(spark, d):
    named = table(spark, d, "orders").where("o_orderkey % 20 = 0").select((F.col("o_custkey") * 2).alias("agent_id"))
    lost, unnamed = sessions.unmatched_agents(named, table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"), (F.col("c_nationkey") == 3).alias("is_compaction")))
    return lost.select(F.lit("no file").alias("kind"), "agent_id").unionByName(unnamed.select(F.lit("not named").alias("kind"), "agent_id"))


@query("""WITH p AS (SELECT o_orderkey AS session_id, o_orderkey - 3 AS p, o_orderkey + 3 AS n FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey AS session_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - 1 END, p) AS prev_id, n AS next_id FROM orders LEFT JOIN p ON o_orderkey = session_id""")
def filled_links(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    index = o.select(k.alias("session_id"), F.when(k % 2 == 0, k - 1).alias("prev_id"), F.lit(None).cast("long").alias("next_id"))
    return sessions.fill_links(index, o.where(k % 3 != 0).select(k.alias("session_id"), (k - 3).alias("prev_id"), (k + 3).alias("next_id")))


@query("SELECT o_orderkey AS session_id, o_orderpriority AS agent FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 0")
def owned_index(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("session_id"), F.col("o_orderpriority").alias("agent"))
    return sessions.owned(rows, o.where(k % 7 != 0).select(k.alias("session_id"), F.when(k % 4 != 0, F.col("o_orderpriority")).otherwise("other").alias("agent")))


@query("""WITH n AS (SELECT l_orderkey AS f, l_partkey AS s, min(l_linenumber * 1000000000::BIGINT + l_partkey) AS p FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p) AS k FROM n), b AS (SELECT DISTINCT y.s AS session_id, x.s AS prev_id FROM k x JOIN k y ON x.f = y.f AND x.k = 1 AND y.k = 2)
SELECT coalesce(b.session_id, a.prev_id) AS session_id, b.prev_id, a.session_id AS next_id FROM b FULL JOIN b AS a ON b.session_id = a.prev_id""")
def continuation_links(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_linenumber") != 5, F.col("l_partkey")).alias("session_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("pos"))
    return sessions.continuations(lines)


@query(f"""WITH {STEPS_SQL}, t AS (SELECT session_id, sum(prompt_tokens) AS tokens FROM st GROUP BY 1), n AS (SELECT session_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS messages FROM st WHERE step_id % 7 <> 0 GROUP BY 1, 2),
p AS (SELECT *, messages / CAST(sum(messages) OVER (PARTITION BY session_id) AS DOUBLE) AS part FROM n)
SELECT session_id, day, messages, CAST(floor(tokens * part) AS BIGINT) AS tokens, round(tokens * 0.001 * part, 6) AS cost_usd FROM p JOIN t USING (session_id)""")
def totals_by_day(spark, d):
    rows = steps(spark, d)
    known = rows.groupBy("session_id").agg(F.sum("prompt_tokens").alias("tokens")).withColumn("cost_usd", F.col("tokens") * F.lit(0.001))
    out = dashboard.spread_totals(known, rows.withColumn("ts", F.when(F.col("step_id") % 7 != 0, F.col("ts"))))
    return out.withColumn("cost_usd", F.round("cost_usd", 6))


@query("""SELECT o_orderkey AS session_id, 'own' AS place FROM orders WHERE o_orderkey % 3 <> 0 AND (o_custkey % 4 = 0 OR o_custkey % 4 = 2)
UNION ALL SELECT o_orderkey, 'example' FROM orders WHERE o_orderkey % 2 = 0 AND NOT (o_orderkey % 3 <> 0 AND (o_custkey % 4 = 0 OR o_custkey % 4 = 2))""")
def visible_sessions(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 4
    rows = lambda part, token, place: part.select(k.alias("session_id"), token.alias("token"), F.lit(place).alias("place"))
    return sessions.visible(rows(o.where(k % 3 != 0), F.when(c != 0, F.concat(F.lit("t"), c)), "own"), rows(o.where(k % 2 == 0), F.lit(None).cast("string"), "example"), "t2").select("session_id", "place")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0")
def overlaid_rows(spark, d):
    o, k, v = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    return sets.overlay(o.where(k % 5 != 0).select(k.alias("id"), v.alias("v")), o.where(k % 3 == 0).select(k.alias("id"), (-v).alias("v")), ["id"])


@query("SELECT p_type AS topic FROM part UNION SELECT p_brand FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part")
def catalog_topics(spark, d):
    return sinks.topics(table(spark, d, "part").select(F.concat(F.array("p_type", "p_brand"), F.split("p_name", " ")).alias("topics")))


@query(f"""WITH {STEPS_SQL}, t AS (SELECT session_id, arg_min(ts, step_idx) AS a, arg_max(ts, step_idx) AS b FROM st WHERE step_id % 3 = 0 GROUP BY 1)
SELECT session_id, CASE WHEN CAST(session_id AS BIGINT) % 4 = 0 THEN TIMESTAMP '2023-12-31 00:00:00' ELSE a END AS created_at, b AS updated_at FROM se LEFT JOIN t USING (session_id)""")
def session_bounds(spark, d):
    fixed = F.when(F.col("session_id").cast("long") % 4 == 0, F.lit("2023-12-31 00:00:00")).cast("timestamp")
    found = sessions_of(spark, d).select("session_id", fixed.alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    timed = steps(spark, d).withColumn("ts", F.when(F.col("step_id") % 3 == 0, F.col("ts")).cast("timestamp"))
    return model.with_bounds(found, timed).select("session_id", F.col("created_at").cast("timestamp_ntz"), F.col("updated_at").cast("timestamp_ntz"))


#: Arguments of seven forms about each event: paths under several keys, blanks and numbers in place of paths, lists, and what is no JSON.
@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '/a/' || user_id WHEN 1 THEN '/d/' || user_id WHEN 3 THEN '/n/' || user_id WHEN 4 THEN '/first' END AS path FROM events""")
def argument_paths(spark, d):
    e, k, u = table(spark, d, "events"), F.col("event_id") % 7, F.col("user_id").cast("string")
    forms = ('{"file_path": "/a/%s"}', '{"path": "", "directory": "/d/%s"}', "plain words %s", '{"filename": 12, "notebook_path": "/n/%s"}', '{"directory": "/last/%s", "file_path": "/first"}', '["/list/%s"]', '{"path": null, "other": {"path": "%s"}}')
    return e.select("event_id", tools.path_of(F.get(F.array(*[F.format_string(f, u) for f in forms]), k.cast("int"))).alias("path"))


#: Contents as parts, as JSON of four forms, and times that are far from today.
@query("""SELECT conv_id, turn, t || ' [image] end' AS with_kinds, t || chr(10) || chr(10) || 'end' AS paragraphs, t || ' end' AS plain,
  CASE turn % 4 WHEN 0 THEN t WHEN 1 THEN t || chr(10) || 'b' || chr(10) || '{"n":1}' WHEN 2 THEN '{"a":' || conv_id || ',"b":[true]}' ELSE '' END AS value,
  make_timestamp(1990 + turn % 60, 5, 6, 7, 8, 9.0) AS at, CASE WHEN turn % 60 BETWEEN 25 AND 44 THEN make_timestamp(1990 + turn % 60, 5, 6, 7, 8, 9.0) END AS believed
FROM (SELECT conv_id, turn, 'said ' || sha256(text) AS t FROM conversations WHERE text IS NOT NULL)""")
def content_texts(spark, d):
    c = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.concat(F.lit("said "), F.sha2("text", 256)).alias("t"))
    part = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.cast("string").alias("text"))
    parts = F.array(part("text", F.col("t")), part("image", F.lit(None)), part("text", F.lit("")), part("text", F.lit("end")))
    forms = F.array(F.format_string('"%s"', "t"), F.format_string('["%s", {"text": "b"}, {"n": 1}]', "t"), F.format_string('{"b": [true], "a": %s}', F.col("conv_id").cast("string")), F.lit("null"))
    at = F.format_string("%d-05-06T07:08:09Z", 1990 + F.col("turn") % 60)
    return c.select(
        "conv_id",
        "turn",
        text.parts_to_text(parts).alias("with_kinds"),
        text.parts_to_text(parts, "\n\n", False).alias("paragraphs"),
        text.parts_to_text(parts, " ", False).alias("plain"),
        text.as_text(F.parse_json(F.get(forms, (F.col("turn") % 4).cast("int")))).alias("value"),
        times.parse_any_iso(at).cast("timestamp_ntz").alias("at"),
        times.parse_iso(at).cast("timestamp_ntz").alias("believed"),
    )


#: Each session's batch answers with one finding that cites a step which may exist and one that does not.
@query(f"""WITH {STEPS_SQL}, f AS (SELECT session_id, CAST(session_id AS BIGINT) AS u FROM se), g AS (SELECT 't' || (u % 30) AS title, greatest(1, least(5, u % 9 - 1)) AS severity, session_id, u % 120 AS step_idx FROM f WHERE u % 11 <> 0),
k AS (SELECT title, session_id, step_idx, row_number() OVER (PARTITION BY title ORDER BY session_id) AS n FROM g SEMI JOIN st USING (session_id, step_idx)),
r AS (SELECT title, string_agg(session_id || ':' || step_idx, ',' ORDER BY session_id) AS refs FROM k WHERE n <= 3 GROUP BY 1), w AS (SELECT title, CAST(max(severity) AS INTEGER) AS severity FROM g GROUP BY 1)
SELECT title, severity, refs FROM r JOIN w USING (title) ORDER BY severity DESC, title LIMIT 20""")
def joined_findings(spark, d):
    u = F.col("session_id").cast("long")
    said = F.format_string('Here:\n```json\n[{"title": "t%d", "severity": %d, "refs": [{"session_id": "%s", "start": %d}, {"session_id": "%s", "start": 900000000}]}]\n```', u % 30, u % 9 - 1, F.col("session_id"), u % 120, F.col("session_id"))
    answers = sessions_of(spark, d).select(F.col("session_id").alias("batch"), (u % 11 != 0).alias("ok"), said.alias("answer"))
    out = report.joined(report.findings(answers), steps(spark, d), most=20)
    return out.select("title", "severity", F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r.getField("session_id"), r.getField("start").cast("string"))), ",").alias("refs"))


#: Chains of three sessions by number; one over the budget falls apart.
@query(f"""WITH RECURSIVE {STEPS_SQL}, c AS (SELECT session_id, min(ts) AS t, count(*) * 30 AS z FROM st GROUP BY 1), h AS (SELECT *, CAST(CAST(session_id AS BIGINT) // 3 * 3 AS VARCHAR) AS head FROM c JOIN se USING (session_id)),
m AS (SELECT *, CASE WHEN sum(z) OVER (PARTITION BY head) <= 7000 THEN head ELSE session_id END AS unit FROM h),
x AS (SELECT unit AS session_id, list(project ORDER BY session_id <> unit, t, session_id)[1] AS project, list(t ORDER BY session_id <> unit, t, session_id)[1] AS t, CAST(sum(z) AS BIGINT) AS tokens FROM m GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, session_id) AS p FROM (SELECT *, coalesce(project, '__unknown__') || '/' || strftime(t, '%Y-%m-01') AS g FROM x)),
rc AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS rooms, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS BIGINT) AS b FROM o UNION ALL
  SELECT g, p, CASE WHEN f IS NULL THEN list_append(rooms, 7000 - z) ELSE list_transform(rooms, lambda v, k: CASE WHEN k = f THEN v - z ELSE v END) END, unit, coalesce(f, len(rooms) + 1) - 1
  FROM (SELECT rc.g, o.p, rooms, o.session_id AS unit, o.tokens AS z, list_filter(range(1, len(rooms) + 1), lambda k: rooms[k] >= o.tokens)[1] AS f FROM rc JOIN o ON o.g = rc.g AND o.p = rc.p + 1))
SELECT m.session_id, g || '/' || b AS batch, z AS tokens FROM m JOIN rc USING (unit)""")
def chain_batches(spark, d):
    s = steps(spark, d).groupBy("session_id").agg(F.min("ts").alias("created_at"), (F.count("*") * 30).alias("tokens")).join(sessions_of(spark, d), "session_id")
    links = s.select("session_id", (F.floor(F.col("session_id").cast("long") / 3) * 3).cast("string").alias("head"))
    return context.pack_chains(s, links, 7000)
