"""Queries for redaction, text and time functions, contexts and completeness, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import model
from tracemill.functions import redact, text, times
from tracemill.functions.models import price_table
from tracemill.operators import completeness, context, packing, proposals, search
from tracemill.parallel import spread
from tracemill.plans.adapters import CONV_SQL, STEPS_SQL, conversation_steps, sessions_of, steps, table

QUERIES, SQL = {}, {}
NOW = "2024-02-01 00:00:00"
EMAIL = dict((n, p) for n, p, _ in redact.PERSONAL)["email"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS n, sha256(regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g')) AS sha FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def redact_email(spark, d):
    docs = table(spark, d, "documents").where(F.regexp_like("text", F.lit(EMAIL)))
    return docs.select("doc_id", F.regexp_count("text", F.lit(EMAIL)).cast("long").alias("n"), F.sha2(redact.redact_native(F.col("text"), EMAIL), 256).alias("sha"))


@query()
def redact_counts(spark, d):
    r = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", redact.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.col("r.count").alias("n"), F.array_join("r.kinds", ",").alias("kinds")).where("n > 0")


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['user_' || left(sha256(CAST(s_suppkey AS VARCHAR) || 'Name'), 8)]) AS kind FROM supplier) GROUP BY 1")
def hash_usernames(spark, d):
    paths = table(spark, d, "supplier").select(F.concat(F.lit("/home/"), F.col("s_suppkey").cast("string"), F.lit("Name/x")).alias("path"))
    h = redact.hash_user_names(paths, "path")
    return h.select(F.regexp_extract("path", "/home/([^/]+)/", 1).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events")
def timestamps_normalized(spark, d):
    e = table(spark, d, "events")
    t = F.col("ts").cast("timestamp")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 4 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.unix_millis(t).cast("string"))
        .otherwise(F.lit("1999-01-01T00:00:00Z"))
    )
    return e.select("event_id", F.unix_micros(times.parse_any(raw)).alias("us"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug, CASE WHEN length(p_name) > 6 THEN left(p_name, 6) || '...' ELSE p_name END AS clipped,
'part-' || left(sha256(CAST(p_partkey AS VARCHAR) || '|' || p_name), 24) AS id FROM part""")
def text_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", text.kebab(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), text.clip(F.col("p_name"), 6).alias("clipped"), text.stable_id("part", F.col("p_partkey"), F.col("p_name")).alias("id"))


@query(f"WITH {CONV_SQL} SELECT session_id, step_idx, CAST(CASE WHEN length(message) > 0 THEN ceil(length(message) / 4.0) ELSE 0 END AS BIGINT) AS tokens FROM cs")
def token_estimates(spark, d):
    return conversation_steps(spark, d).select("session_id", "step_idx", context.token_estimate(F.col("message")).cast("long").alias("tokens"))


@query(f"""WITH {STEPS_SQL}, n AS (SELECT session_id, tool_name, count(*) AS n, min(step_idx) AS f FROM st WHERE tool_name IS NOT NULL GROUP BY 1, 2),
t AS (SELECT session_id, string_agg(tool_name || '(' || n || ')', ', ' ORDER BY n DESC, f) AS tools FROM n GROUP BY 1), c AS (SELECT session_id, count(*) AS steps FROM st GROUP BY 1)
SELECT session_id, '=== SESSION: ' || session_id || ' ===' || chr(10) || 'STEPS: ' || steps || chr(10) || 'TOOLS: ' || tools AS header FROM c JOIN t USING (session_id)""")
def context_headers(spark, d):
    return context.headers(steps(spark, d))


def _contexts(spark, d):
    return context.extracts(conversation_steps(spark, d))


CONTEXT_SQL = f"""{CONV_SQL},
ln AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY step_idx) - 1 AS i, source, regexp_replace(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), '\\n', ' ', 'g') AS m, CASE source WHEN 'user' THEN 1000 ELSE 600 END AS k FROM cs),
pc AS (SELECT session_id, i, row_number() OVER (PARTITION BY session_id ORDER BY i) AS p, '[step_id=' || i || '] ' || upper(source) || ': ' || CASE WHEN length(m) > k THEN left(m, k) || '...' ELSE m END AS line FROM ln WHERE source IN ('user', 'agent') AND m IS NOT NULL),
hd AS (SELECT session_id, '=== SESSION: ' || session_id || ' ===' || chr(10) || 'STEPS: ' || count(*) AS head FROM cs GROUP BY 1),
fu AS (SELECT session_id, head, head || coalesce(chr(10) || chr(10) || (SELECT string_agg(line, chr(10) || chr(10) ORDER BY p) FROM pc WHERE pc.session_id = hd.session_id), '') AS context FROM hd)"""


@query(f"""WITH RECURSIVE {CONTEXT_SQL},
bg AS (SELECT session_id, head, CAST(300 - ceil(length(head) / 4.0) - 5 AS BIGINT) AS room FROM fu WHERE ceil(length(context) / 4.0) > 300),
rc AS (SELECT session_id, CAST(0 AS BIGINT) AS p, CAST(1 AS BIGINT) AS part, CAST(0 AS BIGINT) AS n FROM bg UNION ALL
  SELECT session_id, p, CASE WHEN n > 0 AND n + z > room THEN part + 1 ELSE part END, CASE WHEN n > 0 AND n + z > room THEN z ELSE n + z END
  FROM (SELECT rc.session_id, pc.p, part, n, room, CAST(ceil(length(line) / 4.0) AS BIGINT) AS z FROM rc JOIN bg ON rc.session_id = bg.session_id JOIN pc ON pc.session_id = rc.session_id AND pc.p = rc.p + 1))
SELECT CAST(session_id AS VARCHAR) AS session_id, context FROM fu WHERE session_id NOT IN (SELECT session_id FROM bg)
UNION ALL SELECT rc.session_id || '_part' || part, any_value(head) || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY rc.p) FROM rc JOIN bg ON rc.session_id = bg.session_id JOIN pc ON pc.session_id = rc.session_id AND pc.p = rc.p GROUP BY rc.session_id, part""")
def context_parts(spark, d):
    return context.split_oversized(_contexts(spark, d), 300)


SCORES_SQL = f"""{STEPS_SQL}, s AS (SELECT session_id, count(*) AS steps, max(ts) AS u FROM st GROUP BY 1), e AS (SELECT s.*, coalesce(project, '') AS p FROM s JOIN se USING (session_id) WHERE steps >= 10),
n AS (SELECT p, count(*) AS k FROM e GROUP BY 1),
sc AS (SELECT session_id, steps * 100 AS size, 0.4 * exp(-greatest((epoch(TIMESTAMP '{NOW}') - floor(epoch(u))) / 86400.0, 0) / 30) + 0.3 * CAST(least(steps, 200) AS DOUBLE) / (SELECT max(least(steps, 200)) FROM e) + 0.3 / k AS score FROM e JOIN n USING (p))"""


@query(f"WITH {SCORES_SQL} SELECT session_id, round(score, 4) AS score FROM sc")
def sample_scores(spark, d):
    s = steps(spark, d).groupBy("session_id").agg(F.count("*").alias("steps"), F.max("ts").alias("updated_at")).join(sessions_of(spark, d), "session_id")
    return context.sampling_scores(s.withColumn("size", F.col("steps") * 100), NOW).select("session_id", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE {SCORES_SQL}, rk AS (SELECT row_number() OVER (ORDER BY score DESC, session_id) AS i, session_id, size FROM sc),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(200000 AS BIGINT) AS l, false AS t UNION ALL SELECT f.i + 1, CASE WHEN size <= l THEN l - size ELSE l END, size <= l FROM f JOIN rk ON rk.i = f.i + 1)
SELECT session_id, size FROM rk JOIN f ON rk.i = f.i WHERE t""")
def sampled_sessions(spark, d):
    s = steps(spark, d).groupBy("session_id").agg(F.count("*").alias("steps"), F.max("ts").alias("updated_at")).join(sessions_of(spark, d), "session_id")
    return context.sample(context.sampling_scores(s.withColumn("size", F.col("steps") * 100), NOW), 50_000).select("session_id", "size")


#: First fit, context by context, with the list of what is left of each batch.
@query(f"""WITH RECURSIVE {STEPS_SQL}, c AS (SELECT session_id, min(ts) AS t, count(*) * 30 AS tokens FROM st GROUP BY 1),
x AS (SELECT session_id, coalesce(project, '__unknown__') || '/' || strftime(t, '%Y-%m-01') AS g, tokens, t FROM c JOIN se USING (session_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, session_id) AS p FROM x),
rc AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS rooms, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS tokens FROM o UNION ALL
  SELECT g, p, CASE WHEN f IS NULL THEN list_append(rooms, 5000 - z) ELSE list_transform(rooms, lambda v, k: CASE WHEN k = f THEN v - z ELSE v END) END, session_id, coalesce(f, len(rooms) + 1) - 1, z
  FROM (SELECT rc.g, o.p, rooms, o.session_id, o.tokens AS z, list_filter(range(1, len(rooms) + 1), lambda k: rooms[k] >= o.tokens)[1] AS f FROM rc JOIN o ON o.g = rc.g AND o.p = rc.p + 1))
SELECT session_id, g || '/' || b AS batch, tokens FROM rc WHERE session_id IS NOT NULL""")
def pack_batches(spark, d):
    s = steps(spark, d).groupBy("session_id").agg(F.min("ts").alias("created_at"), (F.count("*") * 30).alias("tokens")).join(sessions_of(spark, d), "session_id")
    return context.pack(s, 5000)


#: The rule step by step over one list of all sessions.
@query(f"""WITH RECURSIVE {STEPS_SQL}, c AS (SELECT session_id, epoch_us(min(ts)) AS t, count(*) * 30 AS z FROM st GROUP BY 1),
x AS (SELECT {{'i': row_number() OVER (ORDER BY coalesce(project, '__unknown__'), t, session_id), 'p': coalesce(project, '__unknown__'), 't': t, 's': session_id, 'z': z}} AS x FROM c JOIN se USING (session_id)),
rc AS (SELECT list(x ORDER BY x.i) AS l, CAST(-1 AS BIGINT) AS b, CAST('' AS VARCHAR) AS p, CAST(0 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS room, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS BIGINT) AS tokens FROM x
  UNION ALL SELECT list_filter(l, lambda v: v.i <> n.i), CASE WHEN k IS NULL THEN b + 1 ELSE b END, CASE WHEN k IS NULL THEN n.p ELSE p END, CASE WHEN k IS NULL THEN n.t ELSE t END, CASE WHEN k IS NULL THEN 5000 ELSE room END - n.z, n.s, n.z
  FROM (SELECT *, coalesce(list_filter(l, lambda v: v.i = k.i)[1], l[1]) AS n
    FROM (SELECT *, list_sort(list_transform(list_filter(l, lambda v: v.z <= room), lambda v: {{'other': v.p <> p, 'far': abs(v.t - t), 'i': v.i}}))[1] AS k FROM rc WHERE len(l) > 0)))
SELECT session_id, 's0.0.' || b AS batch, tokens FROM rc WHERE session_id IS NOT NULL""")
def affinity_batches(spark, d):
    s = steps(spark, d).groupBy("session_id").agg(F.min("ts").alias("created_at"), (F.count("*") * 30).alias("tokens")).join(sessions_of(spark, d), "session_id")
    return packing.pack_by_affinity(s, 5000)


@query("""WITH c AS (SELECT o_custkey AS session_id, o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0), r AS (SELECT o_custkey AS session_id, o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT coalesce(c.session_id, r.session_id) AS session_id, c.id AS c, r.id AS r FROM c FULL JOIN r ON c.session_id = r.session_id AND c.id = r.id)
SELECT session_id, round(greatest(0, least(1, 1 - 0.3 * CAST(count(*) FILTER (WHERE r IS NULL) AS DOUBLE) / greatest(count(c), 1) - 0.2 * CAST(count(*) FILTER (WHERE c IS NULL) AS DOUBLE) / greatest(count(r), 1))), 4) AS score FROM f GROUP BY 1""")
def completeness_score(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("call_id"))
    n = completeness.orphan_counts(o.where("call_id % 4 <> 0"), o.where("call_id % 3 <> 0"))
    return completeness.completeness(n.withColumns({"lines": F.lit(1), "skipped": F.lit(0)})).select("session_id", F.round("score", 4).alias("score"))


@query("""WITH p AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), '\\n', ' ', 'g') AS flat, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN length(html) > 100 THEN left(html, 70) || chr(10) || '...' || chr(10) || right(html, 30) ELSE html END AS ends, CASE WHEN length(flat) > 50 THEN left(flat, 50) || '...' ELSE flat END AS line,
  CASE WHEN len(parts) > 2 THEN '.../' || array_to_string(list_slice(parts, -2, -1), '/') ELSE url END AS tail, url AS whole, url AS inner_text, 'file_path=' || CASE WHEN length(url) > 80 THEN left(url, 80) || '...' ELSE url END AS argument,
  CAST(page_id % 5 AS INTEGER) AS code, CAST(page_id % 100 + 0.5 AS DOUBLE) AS seconds, url AS output, TIMESTAMP '2024-01-01 21:53:00' + to_days(CAST(page_id % 28 AS INTEGER)) AS at,
  left(sha256(array_to_string(list_sort([CAST(page_id AS VARCHAR), url]), ',')), 16) AS set_key, CASE page_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'auto' WHEN 2 THEN 'system' ELSE 'user' END AS author, page_id % 4 IN (1, 3) AS says,
  'page ' || page_id AS title, 'a, b' AS tags, url AS body, 'image/png' AS media FROM p""")
def text_helpers(spark, d):
    p, id_, url = table(spark, d, "pages"), F.col("page_id"), F.col("url")
    lit = F.lit
    ran = F.concat(lit("Exit code: "), (id_ % 5).cast("string"), lit("\nWall time: "), (id_ % 100).cast("string"), lit(".5 seconds\nOutput:\n"), url)
    tagged = F.concat(lit("<timestamp>Monday, "), F.date_format(F.date_add(lit("2024-01-01").cast("date"), (id_ % 28).cast("int")), "MMM d, yyyy"), lit(", 9:53 PM (UTC-4)</timestamp>"))
    said = F.when(id_ % 4 == 0, F.concat(lit("<system-reminder>"), url)).when(id_ % 4 == 1, F.concat(lit("Implement the following plan: "), url)).when(id_ % 4 == 2, lit("[Request interrupted by user]")).otherwise(url)
    matter = F.concat(lit("---\ntitle: \"page "), id_.cast("string"), lit("\"\ntags: [a, b]\n---\n"), url)
    return p.select(
        "page_id",
        text.head_and_tail(F.col("html"), 100).alias("ends"),
        text.one_line(F.col("html"), 50).alias("line"),
        text.short_path(url, 2).alias("tail"),
        text.without_part(F.concat(url, lit("_part12"))).alias("whole"),
        text.fenced(F.concat(lit("Sure:\n```json\n"), url, lit("\n```\nDone."))).alias("inner_text"),
        text.argument_summary(lit("Read"), F.to_json(F.struct(url.alias("file_path")))).alias("argument"),
        text.exit_code(ran).alias("code"),
        text.wall_time(ran).alias("seconds"),
        text.tool_output(ran).alias("output"),
        times.tagged(tagged).alias("at"),
        text.set_key(F.array(id_.cast("string"), url)).alias("set_key"),
        text.user_kind(said).alias("author"),
        text.meaningful_prompt(said).alias("says"),
        F.try_element_at(text.front_matter_values(matter), lit("title")).alias("title"),
        F.try_element_at(text.front_matter_values(matter), lit("tags")).alias("tags"),
        text.body(matter).alias("body"),
        text.data_url(F.concat(lit("data:image/png;base64,"), F.base64(url.cast("binary")))).getField("media_type").alias("media"),
    )


@query(f"""WITH {CONTEXT_SQL}, t AS (SELECT *, sum(CASE WHEN length(context) > 0 THEN ceil(length(context) / 4.0) ELSE 0 END) OVER () AS total FROM fu), k AS (SELECT *, CAST(floor(length(context) * 20000.0 / total) AS BIGINT) AS most FROM t)
SELECT session_id, CASE WHEN total > 20000 AND length(context) > most THEN left(context, CAST(floor(most * CAST(0.7 AS DOUBLE)) AS BIGINT)) || chr(10) || '...' || chr(10) || right(context, most - CAST(floor(most * CAST(0.7 AS DOUBLE)) AS BIGINT)) ELSE context END AS context FROM k""")
def fitted_contexts(spark, d):
    return context.fit_to_budget(_contexts(spark, d), 20_000).select("session_id", "context")


@query(f"""WITH {CONV_SQL} SELECT session_id, sha256(coalesce(string_agg(lower(message), ' ' ORDER BY step_idx) FILTER (WHERE source = 'user' AND message <> ''), '')) AS user_sha, sha256(coalesce(string_agg(lower(message), ' ' ORDER BY step_idx) FILTER (WHERE source = 'agent' AND message <> ''), '')) AS agent_sha,
  coalesce(string_agg('read ' || session_id || ' found ' || step_idx, ' ' ORDER BY step_idx) FILTER (WHERE source = 'agent'), '') AS tool_calls FROM cs GROUP BY 1""")
def session_search_fields(spark, d):
    s = conversation_steps(spark, d)
    calls = s.where("source = 'agent'").select("session_id", "step_idx", F.lit(0).alias("call_pos"), F.col("step_idx").cast("string").alias("call_id"), F.lit("Read").alias("tool_name"), F.to_json(F.struct(F.col("session_id").cast("string").alias("file_path"), F.col("step_idx").alias("line"))).alias("arguments"))
    results = calls.select("session_id", "call_id", F.concat(F.lit("Found "), F.col("step_idx").cast("string")).alias("content"), F.lit(False).alias("is_error"))
    f = search.session_fields(model.Parsed(s.select("session_id").distinct(), s, calls, results))
    return f.select("session_id", F.sha2("user_prompts", 256).alias("user_sha"), F.sha2("agent_messages", 256).alias("agent_sha"), "tool_calls")


@query("""SELECT p_partkey AS item_id, p_name AS name, p_type AS topics, p_brand || ' repo' || (p_partkey % 9) AS author, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' even' ELSE '' END AS description FROM part WHERE p_partkey % 7 <> 0
AND (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red'))""")
def catalog_search_fields(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    items = p.select(k.alias("item_id"), F.when(k % 7 == 0, "mcp_server").otherwise("skill").alias("type"), F.col("p_name").alias("name"), F.array("p_type").alias("topics"), F.col("p_brand").alias("author"), F.concat(F.lit("repo"), k % 9).alias("repo_full_name"), F.col("p_name").alias("description"), F.when(k % 2 == 0, "even").alias("repo_description"), F.lit(None).cast("string").alias("readme"))
    return search.listed_items(search.catalog_fields(items), "Red", ["name", "topics"]).drop("readme")


@query(f"""WITH {STEPS_SQL}, b AS (SELECT session_id, count(*) * 30 AS tokens FROM st GROUP BY 1), n AS (SELECT count(*) AS n, sum(tokens) AS t FROM b)
SELECT 'kimi-k2.5' AS model, n AS batches, CAST(t + 2000 AS BIGINT) AS input_tokens, round(((t + 2000) * 0.556 + (n + 1) * 1000 * 2.917) / 1e6, 6) AS low, round(((t + 2000) * 0.556 + (n + 1) * 2400 * 2.917) / 1e6, 6) AS high FROM n""")
def analysis_cost(spark, d):
    batches = steps(spark, d).groupBy("session_id").agg((F.count("*") * 30).alias("tokens"))
    return context.cost_estimate(batches, price_table(spark), "kimi-k2.5", 4000)


#: Front matter of three forms about each page, by its number.
@query("""WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, url FROM pages), f AS (
SELECT page_id, unnest([{'path': 'name', 'value': 'page ' || n}, {'path': 'metadata.source.url', 'value': url}, {'path': 'metadata.source.kind', 'value': 'web'}, {'path': 'metadata.tags.0', 'value': 'a'}, {'path': 'metadata.tags.1', 'value': 'b'}]) AS e FROM p WHERE page_id % 3 = 0 UNION ALL
SELECT page_id, unnest([{'path': 'hooks.0.id', 'value': n}, {'path': 'hooks.0.run', 'value': 'get ' || url || chr(10) || '  and keep'}, {'path': 'hooks.1.id', 'value': 'last'}, {'path': 'flow.0', 'value': 'x'}, {'path': 'flow.1', 'value': 'y'}]) FROM p WHERE page_id % 3 = 1 UNION ALL
SELECT page_id, unnest([{'path': 'description', 'value': 'page ' || n || chr(10) || 'of ' || url}, {'path': 'quoted key', 'value': 'v: 1'}]) FROM p WHERE page_id % 3 = 2)
SELECT page_id, e.path AS path, e.value AS value FROM f""")
def front_matter_tree(spark, d):
    n, url = F.col("page_id").cast("string"), F.col("url")
    maps = F.format_string("---\nname: page %s\nmetadata:\n  source:\n    url: %s\n    kind: web\n  tags:\n  - a\n  - 'b'\n---\n", n, url)
    lists = F.format_string("---\nhooks:\n  - id: %s\n    run: |\n      get %s\n        and keep\n  - id: last\nflow: [x, 'y']\n---\n", n, url)
    folded = F.format_string("---\ndescription: >-\n  page\n  %s\n\n  of %s\n\"quoted key\": 'v: 1' # note\n---\n", n, url)
    matter = F.when(F.col("page_id") % 3 == 0, maps).when(F.col("page_id") % 3 == 1, lists).otherwise(folded)
    return table(spark, d, "pages").select("page_id", F.explode(text.front_matter_paths(matter)).alias("path", "value"))


#: Three edits of each document: its first characters, a word, and an end.
@query("""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, left(coalesce(text, ''), 12) AS old FROM documents),
b AS (SELECT doc_id, CASE WHEN old = '' THEN t || 'START ' WHEN strpos(substr(t, strpos(t, old) + 1), old) = 0 THEN 'START ' || substr(t, length(old) + 1) ELSE t END AS t, CASE WHEN old = '' OR strpos(substr(t, strpos(t, old) + 1), old) = 0 THEN 1 ELSE 0 END AS n FROM a),
c AS (SELECT doc_id, t, n, strpos(t, 'er ') AS k FROM b),
e AS (SELECT doc_id, n, k > 0 AND strpos(substr(t, k + 1), 'er ') = 0 AS once, t FROM c)
SELECT doc_id, CAST(n + CASE WHEN once THEN 1 ELSE 0 END + 1 AS INTEGER) AS applied, sha256(CASE WHEN once THEN replace(t, 'er ', 'ER ') ELSE t END || ' END') AS sha FROM e""")
def edited_texts(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    first = F.coalesce(F.substring("text", 1, 12), F.lit(""))
    edit = lambda old, new: F.struct(old.alias("old"), F.lit(new).alias("new"))
    edits = F.array(edit(first, "START "), edit(F.lit("er "), "ER "), edit(F.lit(""), " END"))
    r = docs.select("doc_id", proposals.edited(F.col("text"), edits).alias("r"))
    return r.select("doc_id", "r.applied", F.sha2("r.text", 256).alias("sha"))
