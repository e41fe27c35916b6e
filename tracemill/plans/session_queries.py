"""Queries over sessions and their tool calls, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.models import CANONICAL, PRICES, canonical_model, with_cost
from tracemill.functions.tools import CATEGORIES
from tracemill.operators import dashboard, edges, intervals, overlap, phases, sets, usage
from tracemill.plans.adapters import CONV_SQL, STEPS_SQL, conversation_steps, sessions_of, steps, table

NOW = "2024-01-24 12:00:00"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KIND_SQL = "CASE " + " ".join(f"WHEN tool_name IN ({', '.join(repr(n) for n in names)}) THEN '{c}'" for c, names in CATEGORIES.items()) + " ELSE 'other' END"
#: Names of the adapter's models after cleaning, and the prices of those that have one.
CANON_SQL = "CASE " + " ".join(f"WHEN regexp_replace(model, '^([a-z0-9._-]+[/:])+', '') LIKE '{c}%' THEN '{c}'" for c in CANONICAL if c in ("gpt-5-mini", "gemini-2.5-pro", "qwen3-max", "kimi-k2.5")) + " END"
PRICE_SQL = "(VALUES " + ", ".join(f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE), CAST({r} AS DOUBLE), CAST({w} AS DOUBLE))" for m, (i, o, r, w) in PRICES.items()) + ") AS p(pm, pi, po, pr, pw)"
COST_SQL = f"""{STEPS_SQL},
co AS (SELECT st.*, {CANON_SQL} AS canonical_model FROM st),
cu AS (SELECT co.*, (greatest(0, prompt_tokens - cache_read_tokens) * pi + cache_read_tokens * pr + cache_write_tokens * pw + completion_tokens * po) / 1e6 AS cost_usd FROM co LEFT JOIN {PRICE_SQL} ON canonical_model = pm),
ro AS (SELECT session_id, count(*) AS messages, count(tool_name) AS tool_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  sum(cost_usd) AS cost_usd, coalesce(arg_min(model, step_idx) FILTER (WHERE model NOT LIKE '<%'), 'unknown') AS model, arg_min(canonical_model, step_idx) FILTER (WHERE model NOT LIKE '<%') AS canonical_model,
  arg_min(ts, step_idx) AS created_at, arg_max(ts, step_idx) AS updated_at, CAST(floor(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) AS BIGINT) AS duration FROM cu GROUP BY 1),
r AS (SELECT ro.*, project, agent FROM ro JOIN se USING (session_id)),
dd AS (SELECT session_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS messages, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, sum(cost_usd) AS cost_usd FROM cu GROUP BY 1, 2)"""


def _costed(spark: SparkSession, d: str) -> DataFrame:
    return with_cost(steps(spark, d))


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.rollup(_costed(spark, d)).join(sessions_of(spark, d), "session_id")


def _days(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.session_days(_costed(spark, d))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.daily(_rollup(spark, d), _days(spark, d))


USAGE_SQL = f"WITH {STEPS_SQL}, u AS (SELECT session_id, tool_name, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors FROM st WHERE tool_name IS NOT NULL GROUP BY 1, 2) "


@query(USAGE_SQL + "SELECT * FROM u")
def tool_usage_by_session(spark, d):
    return usage.by_session(steps(spark, d))


@query(USAGE_SQL + """, n AS (SELECT count(DISTINCT session_id) AS n FROM st) SELECT tool_name, CAST(sum(calls) AS BIGINT) AS call_count,
  round(CAST(sum(calls) AS DOUBLE) / any_value(n.n), 2) AS avg_per_session, round(CAST(sum(errors) AS DOUBLE) / sum(calls), 3) AS error_rate FROM u, n GROUP BY 1""")
def tool_usage(spark, d):
    s = steps(spark, d)
    return usage.tool_usage(usage.by_session(s), s)


@query(f"""WITH {COST_SQL} SELECT count(*) AS sessions, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
  round(CAST(sum(duration) AS DOUBLE) / 3600, 2) AS hours, round(sum(cost_usd), 6) AS cost_usd, round(CAST(sum(messages) AS DOUBLE) / count(*), 1) AS avg_messages, round(CAST(sum(tool_calls) AS DOUBLE) / count(*), 1) AS avg_tool_calls,
  round(CAST(sum(prompt_tokens + completion_tokens) AS DOUBLE) / count(*), 0) AS avg_tokens, round(CAST(sum(duration) AS DOUBLE) / count(*), 0) AS avg_duration, count(DISTINCT project) AS projects FROM r""")
def dashboard_totals(spark, d):
    return dashboard.totals(_rollup(spark, d))


@query(f"""WITH {COST_SQL} SELECT session_id, messages, tool_calls, prompt_tokens, completion_tokens, round(coalesce(cost_usd, 0), 6) AS cost_usd, model, canonical_model, created_at, updated_at, duration FROM r""")
def session_rollup(spark, d):
    return _rollup(spark, d).select("session_id", "messages", "tool_calls", "prompt_tokens", "completion_tokens", F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).alias("cost_usd"), "model", "canonical_model", "created_at", "updated_at", "duration")


DAILY_SQL = COST_SQL + """,
a AS (SELECT day, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost_usd) AS cost FROM dd GROUP BY 1),
b AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS session_count, CAST(sum(duration) AS BIGINT) AS duration FROM r GROUP BY 1),
dy AS (SELECT coalesce(a.day, b.day) AS day, coalesce(messages, 0) AS messages, coalesce(tokens, 0) AS tokens, round(coalesce(cost, 0), 6) AS cost_usd, coalesce(session_count, 0) AS session_count, coalesce(duration, 0) AS duration FROM a FULL JOIN b ON a.day = b.day)"""


@query(f"WITH {DAILY_SQL} SELECT * FROM dy")
def daily_stats(spark, d):
    return _daily(spark, d)


#: The flagship: what happened on each day.
daily_activity = QUERIES["daily_activity"] = daily_stats
SQL["daily_activity"] = SQL["daily_stats"]


@query(f"""WITH {COST_SQL}, p(period, start) AS (VALUES ('year', '2024-01-01'), ('month', '2024-01-01'), ('week', '2024-01-22')),
x AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, 1 AS sessions, tool_calls, duration, 0 AS messages, 0 AS tokens FROM r UNION ALL SELECT day, 0, 0, 0, messages, tokens FROM dd)
SELECT period, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(duration) AS BIGINT) AS duration, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens
FROM x JOIN p ON day >= start GROUP BY 1""")
def period_stats(spark, d):
    return dashboard.periods(_rollup(spark, d), _days(spark, d), NOW)


@query(f"""WITH {COST_SQL} SELECT 'model' AS kind, model AS key, count(*) AS sessions FROM r GROUP BY 2 UNION ALL SELECT 'project', coalesce(project, '(no project)'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'agent', agent, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'day', strftime(created_at, '%Y-%m-%d'), count(*) FROM r GROUP BY 2""")
def session_histograms(spark, d):
    return dashboard.histograms(_rollup(spark, d))


@query(f"WITH {COST_SQL} SELECT isodow(created_at) - 1 AS weekday, hour(created_at) AS hour, count(*) AS sessions FROM r GROUP BY 1, 2")
def hour_heatmap(spark, d):
    return dashboard.hours(_rollup(spark, d))


@query(f"""WITH {COST_SQL} SELECT coalesce(project, '(no project)') AS project, count(*) AS sessions, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd FROM r GROUP BY 1""")
def project_details(spark, d):
    return dashboard.project_details(_rollup(spark, d))


@query(f"WITH {COST_SQL} SELECT coalesce(canonical_model, model) AS model, round(sum(cost_usd), 6) AS cost_usd FROM r WHERE cost_usd > 0 GROUP BY 1")
def cost_by_model(spark, d):
    return dashboard.cost_by_model(_rollup(spark, d))


@query(f"WITH {COST_SQL} SELECT session_id, project, agent, messages FROM r WHERE project = '/work/p3' AND strftime(created_at, '%Y-%m-%d') BETWEEN '2024-01-01' AND '2024-01-02'")
def filtered_sessions(spark, d):
    return dashboard.metadata_filter(_rollup(spark, d), project="/work/p3", date_from="2024-01-01", date_to="2024-01-02").select("session_id", "project", "agent", "messages")


@query(f"""WITH {DAILY_SQL}, h AS (SELECT * FROM dy WHERE CAST(substr(day, 9, 2) AS INTEGER) % 3 <> 2), g AS (SELECT strftime(unnest(generate_series(min(CAST(day AS DATE)), max(CAST(day AS DATE)), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM h)
SELECT g.day, coalesce(messages, 0) AS messages, coalesce(tokens, 0) AS tokens FROM g LEFT JOIN h ON g.day = h.day""")
def daily_gap_fill(spark, d):
    gaps = _daily(spark, d).where("cast(substring(day, 9, 2) as int) % 3 <> 2")
    return dashboard.fill_days(gaps, ["messages", "tokens"])


@query(f"WITH {DAILY_SQL} SELECT substr(day, 1, 7) AS month, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM dy GROUP BY 1")
def daily_regroup_month(spark, d):
    return dashboard.by_month(_daily(spark, d), ["messages", "tokens"])


@query(f"""WITH {DAILY_SQL}, m AS (SELECT day, messages, ln(messages + 1) / ln(max(messages) OVER () + 1) AS s FROM dy)
SELECT day, messages, CASE WHEN messages <= 0 THEN 0 WHEN s <= 0.25 THEN 1 WHEN s <= 0.5 THEN 2 WHEN s <= 0.75 THEN 3 ELSE 4 END AS level FROM m""")
def log_buckets(spark, d):
    return dashboard.heat_level(_daily(spark, d), "messages")


@query(USAGE_SQL + """, t AS (SELECT tool_name, sum(calls) AS v FROM u GROUP BY 1), k AS (SELECT tool_name, row_number() OVER (ORDER BY v DESC, tool_name) AS n, v FROM t)
SELECT CASE WHEN n <= 3 THEN tool_name ELSE 'other' END AS tool_name, CAST(sum(v) AS BIGINT) AS calls FROM k GROUP BY 1""")
def topn_other(spark, d):
    return dashboard.top_and_other(usage.by_session(steps(spark, d)), "tool_name", "calls", 3)


@query(USAGE_SQL + ", t AS (SELECT tool_name, CAST(sum(calls) AS BIGINT) AS calls FROM u GROUP BY 1) SELECT tool_name, calls, round(CAST(calls AS DOUBLE) / sum(calls) OVER (), 4) AS share FROM t")
def share_of_total(spark, d):
    t = usage.by_session(steps(spark, d)).groupBy("tool_name").agg(F.sum("calls").alias("calls"))
    return dashboard.share(t, "tool_name", "calls")


PHASE_SQL = f"""{STEPS_SQL},
k AS (SELECT session_id, step_idx, is_error, CAST(tool_name IS NOT NULL AS INTEGER) AS n, CASE WHEN tool_name IS NULL THEN '' ELSE {KIND_SQL} END AS kind FROM st WHERE source = 'agent'),
f AS (SELECT session_id, step_idx, sum(n) OVER w AS n, count(*) FILTER (WHERE kind IN ('file_read', 'search')) OVER w AS rs, count(*) FILTER (WHERE kind = 'file_write') OVER w AS wr, count(*) FILTER (WHERE kind = 'shell') OVER w AS sh, bool_or(is_error) OVER w AS err
  FROM k WINDOW w AS (PARTITION BY session_id ORDER BY step_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
ph AS (SELECT session_id, step_idx, CASE WHEN n = 0 THEN 'planning' WHEN err AND (rs + wr) / CAST(n AS DOUBLE) >= 0.3 THEN 'debugging' WHEN sh / CAST(n AS DOUBLE) >= 0.4 AND wr = 0 AND NOT err THEN 'verification'
  WHEN wr / CAST(n AS DOUBLE) >= 0.35 THEN 'implementation' WHEN rs / CAST(n AS DOUBLE) >= 0.5 THEN 'exploration' ELSE 'mixed' END AS phase FROM f),
l AS (SELECT *, lag(phase) OVER (PARTITION BY session_id ORDER BY step_idx) AS p FROM ph),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> phase THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step_idx) AS seg FROM l),
sg AS (SELECT session_id, CAST(seg AS BIGINT) AS seg, phase, min(step_idx) AS start_idx, max(step_idx) AS end_idx FROM i GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN start_idx < end_idx OR row_number() OVER (PARTITION BY session_id ORDER BY seg) = 1 THEN 1 ELSE 0 END AS opens FROM sg),
gr AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY seg) AS grp FROM o),
ab AS (SELECT session_id, arg_min(phase, seg) AS phase, min(start_idx) AS start_idx, max(end_idx) AS end_idx FROM gr GROUP BY session_id, grp)"""


def _phases(spark, d):
    return phases.windows(phases.step_counts(steps(spark, d)))


@query(f"WITH {PHASE_SQL} SELECT * FROM ph")
def phase_windows(spark, d):
    return _phases(spark, d)


@query(f"WITH {PHASE_SQL} SELECT * FROM sg")
def phase_segments(spark, d):
    return phases.segments(_phases(spark, d))


@query(f"WITH {PHASE_SQL} SELECT * FROM ab")
def phase_absorbed(spark, d):
    return phases.absorbed(phases.segments(_phases(spark, d)))


@query(f"""WITH {PHASE_SQL}, h AS (SELECT ab.session_id, start_idx, kind, count(*) AS n, min(step_idx) AS first FROM ab JOIN k ON ab.session_id = k.session_id AND k.step_idx BETWEEN start_idx AND end_idx WHERE k.n = 1 GROUP BY 1, 2, 3),
b AS (SELECT session_id, start_idx, kind, row_number() OVER (PARTITION BY session_id, start_idx ORDER BY n DESC, first) AS q FROM h)
SELECT ab.session_id, ab.start_idx, phase, end_idx, kind AS dominant FROM ab LEFT JOIN b ON ab.session_id = b.session_id AND ab.start_idx = b.start_idx AND q = 1""")
def phase_dominant(spark, d):
    s = steps(spark, d)
    return phases.dominant_category(phases.absorbed(phases.segments(phases.windows(phases.step_counts(s)))), s.where("source = 'agent'"))


CALLS_SQL = f"""{STEPS_SQL},
c AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY step_idx) - 1 AS idx, step_id AS call_id, tool_name, path, is_error, {KIND_SQL} AS kind FROM st WHERE tool_name IS NOT NULL),
lr AS (SELECT *, last_value(CASE WHEN kind = 'file_read' THEN {{'id': call_id, 'idx': idx}} END IGNORE NULLS) OVER (PARTITION BY session_id, path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM c WHERE path <> ''),
rw AS (SELECT session_id, s.id AS source_id, call_id AS target_id, 'read_before_write' AS relation, path AS resource FROM lr WHERE kind = 'file_write' AND idx - s.idx <= 20),
ls AS (SELECT *, last_value(CASE WHEN kind NOT IN ('file_read', 'other') THEN {{'id': call_id, 'idx': idx, 'kind': kind}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM c),
sr AS (SELECT session_id, s.id AS source_id, call_id AS target_id, 'search_then_read' AS relation, coalesce(path, '') AS resource FROM ls WHERE kind = 'file_read' AND s.kind = 'search' AND idx - s.idx <= 12),
lo AS (SELECT *, last_value(CASE WHEN kind <> 'other' THEN {{'id': call_id, 'idx': idx, 'kind': kind, 'path': path}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM c),
wt AS (SELECT session_id, s.id AS source_id, call_id AS target_id, 'write_then_test' AS relation, coalesce(s.path, '') AS resource FROM lo WHERE kind = 'shell' AND s.kind = 'file_write' AND idx - s.idx <= 5),
lm AS (SELECT *, lag(call_id) OVER (PARTITION BY session_id, path ORDER BY idx) AS s FROM c WHERE path <> '' AND kind = 'file_write'),
me AS (SELECT session_id, s AS source_id, call_id AS target_id, 'multi_edit' AS relation, path AS resource FROM lm WHERE s IS NOT NULL),
al AS (SELECT * FROM rw UNION ALL SELECT * FROM sr UNION ALL SELECT * FROM wt UNION ALL SELECT * FROM me),
lg AS (SELECT session_id, lag(call_id) OVER (PARTITION BY session_id ORDER BY idx) AS source_id, call_id AS target_id FROM c),
sq AS (SELECT session_id, source_id, target_id, 'sequential' AS relation, '' AS resource FROM lg WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM al WHERE al.session_id = lg.session_id AND al.target_id = lg.target_id))"""


@query(f"WITH {CALLS_SQL} SELECT * FROM rw")
def edges_read_before_write(spark, d):
    return edges.read_before_write(edges.numbered(steps(spark, d)))


@query(f"WITH {CALLS_SQL} SELECT * FROM sr")
def edges_search_then_read(spark, d):
    return edges.search_then_read(edges.numbered(steps(spark, d)))


@query(f"WITH {CALLS_SQL} SELECT * FROM wt")
def edges_write_then_test(spark, d):
    return edges.write_then_test(edges.numbered(steps(spark, d)))


@query(f"WITH {CALLS_SQL} SELECT * FROM me")
def edges_multi_edit(spark, d):
    return edges.multi_edit(edges.numbered(steps(spark, d)))


@query(f"WITH {CALLS_SQL} SELECT * FROM sq")
def edges_sequential(spark, d):
    c = edges.numbered(steps(spark, d))
    strong = edges.read_before_write(c).unionByName(edges.search_then_read(c)).unionByName(edges.write_then_test(c)).unionByName(edges.multi_edit(c))
    return edges.sequential(c, strong)


#: Call by call with the list of calls that are taken.
RETRY_SQL = CALLS_SQL + """,
ar AS (SELECT session_id, list(tool_name ORDER BY idx) AS t, list(is_error ORDER BY idx) AS e, list(call_id ORDER BY idx) AS ids FROM c GROUP BY 1),
rs AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS j FROM ar UNION ALL
  SELECT session_id, i + 1, CASE WHEN nj IS NULL THEN taken ELSE list_append(taken, nj) END, nj FROM (SELECT rs.session_id, i, taken, len(t) AS n,
    CASE WHEN e[i + 1] AND NOT list_contains(taken, i + 1) THEN list_filter(range(i + 2, least(i + 8, len(t) + 1)), lambda k: t[k] = t[i + 1] AND NOT list_contains(taken, k))[1] END AS nj
    FROM rs JOIN ar ON rs.session_id = ar.session_id) WHERE i < n),
er AS (SELECT rs.session_id, ids[i] AS source_id, ids[j] AS target_id, 'error_retry' AS relation, '' AS resource FROM rs JOIN ar ON rs.session_id = ar.session_id WHERE j IS NOT NULL),
a2 AS (SELECT * FROM al UNION ALL SELECT * FROM er),
gr AS (SELECT * FROM a2 UNION ALL SELECT session_id, source_id, target_id, 'sequential', '' FROM lg WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a2 WHERE a2.session_id = lg.session_id AND a2.target_id = lg.target_id))"""


@query(f"WITH RECURSIVE {RETRY_SQL} SELECT * FROM er")
def edges_error_retry(spark, d):
    return edges.error_retry(edges.numbered(steps(spark, d)))


@query(f"WITH RECURSIVE {RETRY_SQL} SELECT * FROM gr")
def tool_graph(spark, d):
    return edges.all_edges(edges.numbered(steps(spark, d)))


@query(f"WITH RECURSIVE {RETRY_SQL} SELECT session_id, call_id FROM c WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.session_id = c.session_id AND gr.target_id = c.call_id)")
def tool_graph_roots(spark, d):
    c = edges.numbered(steps(spark, d))
    return edges.roots(c, edges.all_edges(c))


#: A user's days as sessions of their own give intervals that overlap or not.
DAY_SESSIONS_SQL = """ds AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, '/work/p' || (user_id % 7) AS project, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'), user_id % 7),
pr AS (SELECT a.project, CASE WHEN (a.created_at, a.session_id) < (b.created_at, b.session_id) THEN a.session_id ELSE b.session_id END AS a, CASE WHEN (a.created_at, a.session_id) < (b.created_at, b.session_id) THEN b.session_id ELSE a.session_id END AS b,
  CAST(floor((epoch_us(least(a.updated_at, b.updated_at)) - epoch_us(greatest(a.created_at, b.created_at))) / 1e6) AS BIGINT) AS seconds FROM ds a JOIN ds b ON a.project = b.project AND a.session_id < b.session_id AND a.created_at < b.updated_at AND b.created_at < a.updated_at)"""


def _day_sessions(spark, d):
    e = table(spark, d, "events")
    # Days as dates: four bytes in the shuffle.
    g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return g.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("session_id"), F.concat(F.lit("/work/p"), F.col("user_id") % 7).alias("project"), "created_at", "updated_at", F.timestamp_diff("SECOND", "created_at", "updated_at").alias("duration"))


@query(f"WITH {DAY_SESSIONS_SQL} SELECT * FROM pr WHERE seconds > 0")
def overlapping_sessions(spark, d):
    # Where a session has one step its end is the start, and nothing overlaps an empty interval here.
    return overlap.overlapping_pairs(_day_sessions(spark, d).where("updated_at > created_at"))


@query(f"WITH {DAY_SESSIONS_SQL}, e AS (SELECT project, a AS s, seconds FROM pr WHERE seconds > 0 UNION ALL SELECT project, b, seconds FROM pr WHERE seconds > 0) SELECT project, count(DISTINCT s) AS sessions, max(seconds) AS max_seconds FROM e GROUP BY 1")
def overlap_groups(spark, d):
    return overlap.overlap_groups(_day_sessions(spark, d).where("updated_at > created_at"))


REFS_SQL = "rf AS (SELECT user_id AS u, CAST(user_id AS VARCHAR) AS session_id, user_id % 5 AS ref_start, user_id % 5 + user_id % 17 AS ref_end, user_id % 4 + 1 AS severity FROM (SELECT DISTINCT user_id FROM events))"


@query(f"""WITH {COST_SQL}, {REFS_SQL} SELECT session_id, ref_start, ref_end, count(*) AS steps, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 6) AS cost_usd,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS seconds FROM rf JOIN cu USING (session_id) WHERE step_idx BETWEEN ref_start AND ref_end GROUP BY 1, 2, 3""")
def span_cost(spark, d):
    u = F.col("user_id")
    refs = table(spark, d, "events").select("user_id").distinct().select(u.cast("string").alias("session_id"), (u % 5).alias("ref_start"), (u % 5 + u % 17).alias("ref_end"))
    hit = intervals.points_in_ranges(_costed(spark, d), refs, "session_id", "step_idx", "ref_start", "ref_end")
    return hit.groupBy("session_id", "ref_start", "ref_end").agg(F.count("*").alias("steps"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"))


@query(f"WITH {CONV_SQL} SELECT session_id, source, count(*) AS steps FROM cs GROUP BY 1, 2")
def steps_by_source(spark, d):
    return conversation_steps(spark, d).groupBy("session_id", "source").agg(F.count("*").alias("steps"))


@query(f"WITH {CONV_SQL} SELECT session_id, arg_min(message, step_idx) AS message FROM cs WHERE source = 'user' AND trim(message) <> '' GROUP BY 1")
def first_user_message(spark, d):
    return conversation_steps(spark, d).where("source = 'user' and trim(message) <> ''").groupBy("session_id").agg(F.min_by("message", "step_idx").alias("message"))


@query(f"WITH {COST_SQL} SELECT session_id, updated_at, messages FROM r ORDER BY updated_at DESC, session_id OFFSET 20 LIMIT 25")
def session_list_page(spark, d):
    return sets.pages(_rollup(spark, d).select("session_id", "updated_at", "messages"), [F.desc("updated_at"), F.asc("session_id")], 20, 25)


@query(f"WITH {STEPS_SQL} SELECT DISTINCT project FROM se WHERE project IS NOT NULL")
def projects(spark, d):
    return sessions_of(spark, d).where("project is not null").select("project").distinct().orderBy("project")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'new' WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 THEN 'removed' WHEN o_orderkey % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def index_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("stamp"))
    now, before = o.where("id % 3 = 0"), o.where("id % 5 = 0").withColumn("stamp", F.when(F.col("id") % 2 == 0, F.col("stamp")).otherwise(F.col("stamp") - F.expr("interval 1 day")))
    return sets.change_kind(now, before, "id", "stamp")


@query("""SELECT l_orderkey AS id, 'line' AS origin, min(l_linenumber) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1
UNION ALL SELECT o_orderkey, 'order', 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 2 = 0)""")
def union_first_wins(spark, d):
    a = table(spark, d, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("origin"), F.col("l_linenumber").alias("n"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("origin"), F.lit(0).alias("n"))
    return sets.union_first_wins([a, b], ["id"], [F.col("n")])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_first(spark, d):
    return sets.first_by(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""SELECT 'order without line' AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_quantity > 30 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def orphans(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 30")
    calls, _ = sets.gather_orphans(o.select(F.col("o_orderkey").alias("id")), l.select(F.col("l_orderkey").alias("id")), ["id"])
    _, results = sets.gather_orphans(o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")), l.select(F.col("l_orderkey").alias("id")), ["id"])
    count = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return count(calls, "order without line").unionByName(count(results, "line without order"))


@query(f"""WITH {STEPS_SQL}, n AS (SELECT session_id, tool_name, count(*) AS n, min(step_idx) AS f FROM st WHERE tool_name IS NOT NULL GROUP BY 1, 2)
SELECT session_id, tool_name FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) AS q FROM n) WHERE q = 1""")
def favourite_tool(spark, d):
    return sets.mode_first(steps(spark, d), ["session_id"], "tool_name", "step_idx")


@query("""SELECT raw, CASE raw WHEN 'openai/gpt-5-mini-2025-08-07' THEN 'gpt-5-mini' WHEN 'models/gemini-2.5-pro' THEN 'gemini-2.5-pro' WHEN 'qwen/qwen3-max' THEN 'qwen3-max' WHEN 'kimi-k2.5' THEN 'kimi-k2.5' END AS canonical
FROM (SELECT DISTINCT model AS raw FROM (WITH """ + STEPS_SQL + " SELECT model FROM st))")
def normalize_model(spark, d):
    return steps(spark, d).select(F.col("model").alias("raw")).distinct().select("raw", canonical_model(F.col("raw")).alias("canonical"))


@query(f"""WITH {COST_SQL} SELECT session_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens,
  round(sum(cost_usd), 6) AS cost_usd, count(*) AS steps, count(tool_name) AS tool_calls, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days FROM cu GROUP BY 1""")
def final_metrics(spark, d):
    return dashboard.final_metrics(_costed(spark, d)).withColumn("days", F.size("days").cast("long"))


@query(f"WITH {COST_SQL} SELECT session_id, day, messages, tokens, round(coalesce(cost_usd, 0), 9) AS cost_usd FROM dd")
def final_metric_days(spark, d):
    return dashboard.final_metrics(_costed(spark, d)).select("session_id", F.explode("days").alias("day", "v")).select("session_id", "day", "v.messages", "v.tokens", F.round("v.cost_usd", 9).alias("cost_usd"))


@query(f"WITH {STEPS_SQL}, n AS (SELECT session_id, count(*) AS n FROM st GROUP BY 1) SELECT project, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS steps FROM se JOIN n USING (session_id) GROUP BY 1")
def detail_counts(spark, d):
    return dashboard.detail_counts(steps(spark, d), sessions_of(spark, d), "project")
