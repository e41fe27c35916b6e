"""Queries over what Spark stores of the tables: SQLite files, followed logs, commits, index segments, names in shards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill import manifests
from tracemill.durable import shared_folder
from tracemill.functions import redact
from tracemill.operators import search
from tracemill.plans.adapters import table
from tracemill.plans.search_queries import TOKENS_SQL, TWO, _docs
from tracemill.sources import sqlite_source
from tracemill.streaming import following

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size >= 40")
def sqlite_scan(spark, d):
    path = _folder(spark, "sqlite")
    sqlite_source.save(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, "part")
    return sqlite_source.scan(spark, path, "*.db", "part", "p_partkey long, p_name string, p_size int, p_retailprice double", [("p_size", ">=", 40)]).drop("file")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def followed_logs(spark, d):
    """Events as lines of logs, followed once before and once after the second half has come."""
    logs, store = _folder(spark, "logs"), _folder(spark, "followed")
    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"), (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        lines.where(F.col("half") == half).select("value").write.mode("append").text(logs)
        following.follow(spark, logs, store, "*.txt")
    v = F.from_json("line", "event_id long, event_type string")
    return following.current_lines(spark, store).select(v.alias("v")).groupBy(F.col("v.event_type").alias("event_type")).agg(F.count("*").alias("n"), F.sum("v.event_id").alias("ids"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")
def committed_store(spark, d):
    """Rows appended in two commits, and those of a negative balance removed by a third."""
    path, rows = _folder(spark, "store"), table(spark, d, "supplier")
    for half in (0, 1):
        manifests.append(rows.where(F.coalesce(F.col("s_suppkey"), F.lit(0)) % 2 == half), path)
    manifests.remove(spark, path, F.col("s_acctbal") < 0)
    return manifests.rows_of(spark, path).select("s_suppkey", "s_name")


@query(f"WITH {TOKENS_SQL} SELECT doc, round(sum(score), 4) AS score FROM sc WHERE field = 'user_prompts' AND token IN ('onen', 'erhe', 'onst') GROUP BY 1")
def bm25_refreshed(spark, d):
    """Scores by an index that was stored with a hundredth of the documents missing and a hundredth out of date, and then refreshed."""
    docs, fields = _docs(spark, d), ["user_prompts", "agent_messages", "tool_calls"]
    turn = F.pmod(F.xxhash64("doc"), F.lit(100))
    before = docs.where(turn != 0).withColumn("user_prompts", F.when(turn == 1, "onen out of date").otherwise(F.col("user_prompts")))
    index = search.stored(before, "doc", fields, _folder(spark, "index"))
    diff = docs.select("doc", F.when(turn == 0, "new").when(turn == 1, "changed").otherwise("unchanged").alias("kind"))
    return search.field_scores(search.refresh(index, docs, diff, "doc", fields), TWO, ["user_prompts"]).select("doc", F.round("score", 4).alias("score"))


@query("SELECT o_orderkey, 'user_' || left(sha256(CAST(o_orderkey AS VARCHAR) || 'Name'), 8) AS hashed FROM orders")
def hash_usernames_in_shards(spark, d):
    """A name for each order, in shards of 5,000."""
    key = F.col("o_orderkey").cast("string")
    texts = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/home/"), key, F.lit("Name/x")).alias("path"))
    return redact.hash_user_names(texts, "path", shard=5_000).select("o_orderkey", F.regexp_extract("path", "/home/([^/]+)/", 1).alias("hashed"))


@query("""SELECT event_id, '{"props": ' || props || ', "note": "say [REDACTED] now"}' AS text FROM events""")
def redacted_json(spark, d):
    secret = F.concat(F.lit('", "note": "say \\"password\\": \\"hunter'), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit('\\" now"}'))
    text = F.concat(F.lit('{"props": '), F.col("props"), F.substring(secret, 2, 1000))
    return table(spark, d, "events").select("event_id", redact.redact_json(text).getField("text").alias("text"))
