"""Search queries over documents and parts, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill import manifests
from tracemill.durable import shared_folder
from tracemill.operators import search
from tracemill.plans.adapters import table
from tracemill.streaming import incremental

QUERIES, SQL = {}, {}
QUERY, TWO, NOW = "onen erhe", "onen erhe onst", "2024-06-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in search.STOPWORDS.split()) + "]"
STEM_SQL = "CASE WHEN t LIKE '%ies' AND length(t) >= 6 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ing' AND length(t) >= 6 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' AND length(t) >= 5 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) >= 4 THEN left(t, length(t) - 1) ELSE t END"
FIELDS_SQL = "fl AS (SELECT doc_id AS doc, 'user_prompts' AS field, text AS x FROM documents UNION ALL SELECT doc_id, 'agent_messages', lang || ' ' || source FROM documents UNION ALL SELECT doc_id, 'tool_calls', source FROM documents)"
TOKENS_SQL = f"""{FIELDS_SQL},
tk AS (SELECT doc, field, list_transform(list_filter(regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains({STOP_SQL}, t)), lambda t: {STEM_SQL}) AS t FROM fl),
ts AS (SELECT doc, field, CASE WHEN len(t) = 0 THEN [''] ELSE t END AS t FROM tk),
po AS (SELECT field, doc, token, count(*) AS tf FROM (SELECT field, doc, unnest(t) AS token FROM ts) GROUP BY 1, 2, 3),
dl AS (SELECT field, doc, len(t) AS dl FROM ts), fs AS (SELECT field, count(*) AS docs, avg(dl) AS avgdl FROM dl GROUP BY 1),
vo AS (SELECT po.field, token, count(*) AS n, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM po JOIN fs ON po.field = fs.field GROUP BY 1, 2),
me AS (SELECT field, avg(idf) AS m FROM vo GROUP BY 1),
sc AS (SELECT po.field, po.doc, po.token, (CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS score
  FROM po JOIN vo ON po.field = vo.field AND po.token = vo.token JOIN fs ON po.field = fs.field JOIN me ON po.field = me.field JOIN dl ON po.field = dl.field AND po.doc = dl.doc)"""


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("user_prompts"), F.concat_ws(" ", "lang", "source").alias("agent_messages"), F.col("source").alias("tool_calls"))


#: Indexes that this process has stored: place and stamp of the tables' files, by application, place and what is indexed.
_STORED: dict[tuple[str, str, str], tuple[int, str]] = {}


def _kept(spark, d, name, source, docs, doc, fields):
    """An index, stored by the first query that asks for it and read by the others; stored anew where the table's files are others."""
    key = (spark.sparkContext.applicationId, d, name)
    listing = incremental.file_listing(spark, f"{d}/{source}.parquet", "*")
    stamp = listing.agg(F.bit_xor(F.xxhash64("file", "stamp"))).first()[0]
    if key in _STORED and _STORED[key][0] == stamp:
        return search.Index.read(spark, _STORED[key][1])
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    index = search.stored(docs, doc, fields, path)
    if key in _STORED:
        manifests.delete(spark, _STORED[key][1])
    _STORED[key] = (stamp, path)
    return index


def search_index(spark, d):
    """The index of the documents."""
    return _kept(spark, d, "search", "documents", _docs(spark, d), "doc", ["user_prompts", "agent_messages", "tool_calls"])


def _items(spark, d):
    """Parts as items of a catalogue."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("p_partkey") % 3000).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.lit("part").alias("type"), F.col("p_name").alias("name"), F.col("p_type").alias("topics"), F.col("p_brand").alias("author"), F.concat_ws(" ", "p_name", "p_type").alias("description"), F.lit("").alias("readme"), (F.col("p_size") * 2).alias("quality_score"), (F.col("p_retailprice") / 2000.0).alias("popularity"), at.alias("updated_at"))


def catalog_index(spark, d):
    """The index of the catalogue."""
    return _kept(spark, d, "catalog", "part", _items(spark, d), "item_id", list(search.CATALOG_WEIGHTS))


@query(f"WITH {TOKENS_SQL} SELECT field, token, n, round(idf, 6) AS idf FROM vo")
def tokenize_stats(spark, d):
    return search_index(spark, d).vocabulary.withColumn("idf", F.round("idf", 6))


@query(f"WITH {TOKENS_SQL} SELECT doc, round(sum(score), 4) AS score FROM sc WHERE field = 'user_prompts' AND token IN ('onen', 'erhe', 'onst') GROUP BY 1")
def bm25_text(spark, d):
    return search.field_scores(search_index(spark, d), TWO, ["user_prompts"]).select("doc", F.round("score", 4).alias("score"))


BLEND_SQL = TOKENS_SQL + """, bl AS (SELECT doc, sum(score * CASE field WHEN 'user_prompts' THEN 4 WHEN 'agent_messages' THEN 2 ELSE 1 END) AS raw FROM sc WHERE token IN ('onen', 'erhe') GROUP BY 1 HAVING count(DISTINCT token) = 2),
co AS (SELECT doc, raw / max(raw) OVER () AS composite FROM bl)"""


@query(f"WITH {BLEND_SQL} SELECT doc, round(composite, 4) AS composite FROM co")
def bm25_blend(spark, d):
    return search.blended(search_index(spark, d), QUERY, search.SESSION_WEIGHTS).select("doc", F.round("composite", 4).alias("composite"))


#: A query whose last word is not finished; the first ten words that begin so are tried.
UNFINISHED = "onen ero"
COMPLETED_SQL = TOKENS_SQL + """, ex AS (SELECT DISTINCT token FROM vo WHERE starts_with(token, 'ero') ORDER BY token LIMIT 10),
bl AS (SELECT doc, sum(score * CASE field WHEN 'user_prompts' THEN 4 WHEN 'agent_messages' THEN 2 ELSE 1 END) AS raw FROM sc WHERE token = 'onen' OR token IN (SELECT token FROM ex) GROUP BY 1
  HAVING bool_or(token = 'onen') AND bool_or(token IN (SELECT token FROM ex)))"""


@query(f"WITH {COMPLETED_SQL} SELECT doc, round(raw / max(raw) OVER (), 4) AS composite FROM bl")
def search_unfinished_word(spark, d):
    return search.blended(search_index(spark, d), UNFINISHED, search.SESSION_WEIGHTS).select("doc", F.round("composite", 4).alias("composite"))


@query(f"WITH {COMPLETED_SQL} SELECT token FROM ex")
def completions(spark, d):
    found = search_index(spark, d).completions("ero", 10)
    return spark.createDataFrame([(t,) for t in found], "token string")


PHRASE = "er th"
BONUS_SQL = f"bo AS (SELECT doc_id AS doc, CASE WHEN contains(lower(text), '{PHRASE}') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(lang || ' ' || source), '{PHRASE}') THEN 0.7 ELSE 0 END + CASE WHEN contains(lower(source), '{PHRASE}') THEN 0.3 ELSE 0 END AS bonus FROM documents)"


@query(f"WITH {BONUS_SQL} SELECT doc, round(CAST(bonus AS DOUBLE), 4) AS bonus FROM bo WHERE bonus > 0")
def phrase_bonus(spark, d):
    return search.phrase_bonus(_docs(spark, d), "doc", PHRASE, search.PHRASE_WEIGHTS).select("doc", F.round("bonus", 4).alias("bonus"))


@query(f"""WITH {TOKENS_SQL}, {BONUS_SQL}, bl AS (SELECT doc, sum(score * CASE field WHEN 'user_prompts' THEN 4 WHEN 'agent_messages' THEN 2 ELSE 1 END) AS raw FROM sc WHERE token IN ('er', 'th') GROUP BY 1 HAVING count(DISTINCT token) = 2),
co AS (SELECT doc, raw / max(raw) OVER () AS composite FROM bl), fl2 AS (SELECT doc, CASE WHEN composite < 0.1 * max(composite) OVER () THEN 0 ELSE composite END AS composite FROM co),
fi AS (SELECT bl.doc, composite * greatest(exp(-(epoch(TIMESTAMP '{NOW}') - epoch(TIMESTAMP '2024-01-01' + to_hours(CAST(bl.doc AS INTEGER)))) / 86400.0 / 60), 0.3) + coalesce(bonus, 0) AS score FROM bl JOIN fl2 ON bl.doc = fl2.doc LEFT JOIN bo ON bl.doc = bo.doc)
SELECT CAST(doc AS VARCHAR) AS doc, 0 AS tier, round(score, 4) AS score FROM fi WHERE score > 0 ORDER BY fi.score DESC, doc LIMIT 40""")
def search_ranked(spark, d):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("doc").cast("int"))
    docs = _docs(spark, d).select(F.col("doc").cast("string").alias("session_id"), "user_prompts", "agent_messages", "tool_calls", at.alias("updated_at"))
    return search.rank_sessions(search_index(spark, d).with_doc("string"), docs, PHRASE, NOW, top=40).select("doc", "tier", F.round("score", 4).alias("score"))


@query(f"""WITH fl AS (SELECT p_partkey AS doc, 'name' AS field, p_name AS x FROM part UNION ALL SELECT p_partkey, 'topics', p_type FROM part UNION ALL SELECT p_partkey, 'author', p_brand FROM part UNION ALL SELECT p_partkey, 'description', p_name || ' ' || p_type FROM part),
{TOKENS_SQL[len(FIELDS_SQL) + 1 :]},
bl AS (SELECT doc, sum(score * CASE field WHEN 'name' THEN 5 WHEN 'topics' THEN 3 WHEN 'author' THEN 2 WHEN 'description' THEN 1 ELSE 0.5 END) AS raw FROM sc WHERE token IN ('red', 'widget') GROUP BY 1 HAVING count(DISTINCT token) = 2),
tx AS (SELECT doc, raw / max(raw) OVER () AS text FROM bl),
ns AS (SELECT p_partkey AS item_id, p_name AS name, CASE WHEN list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'red') THEN 10 ELSE 0 END + CASE WHEN list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget') THEN 10 ELSE 0 END
  + CASE WHEN contains(lower(p_name), 'red widget') THEN 1 ELSE 0 END + CASE WHEN list_has_all(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ['red', 'widget']) THEN 500 ELSE 0 END + CASE WHEN regexp_replace(lower(p_name), '[\\s_\\-]+', '', 'g') = 'redwidget' THEN 1000 ELSE 0 END AS name_score,
  coalesce(text, 0) * 0.375 + least(1, p_size * 2 / 100.0) * 0.375 + least(1, p_retailprice / 2000.0) * 0.125 + exp(-(epoch(TIMESTAMP '{NOW}') - epoch(TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 3000 AS INTEGER)))) / 86400.0 / 180) * 0.125 AS score, text FROM part LEFT JOIN tx ON doc = p_partkey)
SELECT item_id, name, name_score, round(score, 4) AS score FROM ns WHERE name_score > 0 OR text > 0 ORDER BY name_score DESC, ns.score DESC, name, item_id LIMIT 100""")
def catalog_rank(spark, d):
    items = _items(spark, d)
    return search.rank_catalog(items, "red widget", NOW, index=catalog_index(spark, d), top=100).select("item_id", "name", "name_score", F.round("score", 4).alias("score"))
