"""SQLite files by table and by query; and the agents that keep their sessions in such files."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracemill.functions import times
from tracemill.model import Parsed
from tracemill.sources.sqlite_source import is_local, local_path, opened, scan
from tracemill.sources.lines import get, items, json_documents, json_lines, numbered, raw, tables, text_of, ts_of, with_spawns


def query(spark: SparkSession, path: str, glob: str, sql: str, schema: str) -> DataFrame:
    """file and the rows of an SQL query over each SQLite file.

    The query runs inside SQLite, so its conditions are pushed down. A file is read by one
    task, from where it lies or, in a store that only Spark reads, from its bytes; table()
    splits files. A file that is no database, or lacks a table, gives no rows; unreadable()
    names it.
    """
    fields = T._parse_datatype_string(schema).fields

    def rows(con: sqlite3.Connection, file: str) -> Iterator[pd.DataFrame]:
        cursor = con.execute(sql)
        while found := cursor.fetchmany(5000):
            out = pd.DataFrame(found, columns=[f.name for f in fields], dtype=object)
            out.insert(0, "file", file)
            yield out

    return _over_files(spark, path, glob, rows, lambda file, error: iter(()), "file string, " + schema)


def unreadable(spark: SparkSession, path: str, glob: str, sql: str) -> DataFrame:
    """file, pos, value of each file over which the query fails; value is SQLite's message. The columns are those of rejected lines."""

    def tried(con: sqlite3.Connection, file: str) -> Iterator[pd.DataFrame]:
        con.execute(sql).fetchone()
        return iter(())

    failed = lambda file, error: iter([pd.DataFrame({"file": [file], "value": [str(error)]})])
    found = _over_files(spark, path, glob, tried, failed, "file string, value string")
    return found.select("file", F.lit(None).cast("struct<block:bigint,id:bigint>").alias("pos"), "value")


def _over_files(spark: SparkSession, path: str, glob: str, rows: Callable, failed: Callable, schema: str) -> DataFrame:
    """rows(connection, file) of each file, and failed(file, error) of those that are no database."""
    local = is_local(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["path"] if local else b["content"], strict=True):
                con = None
                try:
                    if local:
                        con = opened(local_path(file))
                    else:
                        con = sqlite3.connect(":memory:")
                        con.deserialize(bytes(content))
                    yield from rows(con, file)
                except sqlite3.DatabaseError as e:
                    yield from failed(file, e)
                finally:
                    if con:
                        con.close()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", *([] if local else ["content"])).mapInPandas(run, schema)


def table(spark: SparkSession, path: str, glob: str, name: str, schema: str, only: tuple[str, list[str]] | None = None) -> DataFrame:
    """file and columns of a table in all files, by ranges of row ids where Python can open them.

    only names a column and the values that are wanted, which SQLite looks up.
    """
    if is_local(spark, path):
        return scan(spark, path, glob, name, schema, [(only[0], "in", only[1])] if only else None)
    columns = ", ".join(f'"{f.name}"' for f in T._parse_datatype_string(schema).fields)
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    where = f" WHERE \"{only[0]}\" IN ({', '.join(map(quoted, only[1]))})" if only else ""
    return query(spark, path, glob, f'SELECT {columns} FROM "{name}"{where}', schema)


def read_opencode(spark: SparkSession, path: str, glob: str = "opencode.db", agent: str = "opencode", session_id: str | None = None) -> Parsed:
    """Tables session, message and part; many sessions in a file. session_id reads one session and its children only."""
    of = lambda name, schema, only=None: table(spark, path, glob, name, schema, only)
    columns, own = "id string, parent_id string, directory string, title string, time_created long, time_updated long", None
    s = of("session", columns)
    if session_id is not None:
        # A session and those it started: their ids go into the scans of the other tables.
        children = of("session", columns, ("parent_id", [session_id]))
        s = of("session", columns, ("id", [session_id])).unionByName(children.where(F.col("id") != session_id))
        own = ("session_id", [session_id, *sorted(r.id for r in children.where(F.col("id") != session_id).select("id").collect())])
    m = of("message", "id string, session_id string, time_created long, data string", own)
    p = of("part", "id string, message_id string, session_id string, time_created long, data string", own)
    s = s.select("file", F.col("id").alias("session_id"), "parent_id", F.col("directory").alias("project"), "title", F.col("time_created").alias("created"), F.col("time_updated").alias("updated"))
    m, p = (df.withColumnRenamed("time_created", "created").withColumn("v", F.try_parse_json("data")) for df in (m, p))
    order = F.array_sort(F.collect_list(F.when(get("v", "$.type") == "text", F.struct("created", "id", get("v", "$.text").alias("t")))))
    said = p.groupBy("session_id", F.col("message_id").alias("id")).agg(F.array_join(F.transform(order, lambda x: x.getField("t")), "\n\n").alias("message"), F.bool_or(F.coalesce(get("v", "$.type") == "compaction", F.lit(False))).alias("is_compaction"))
    k = "$.tokens"
    steps = m.drop("file").join(said, ["session_id", "id"], "left").select(
        "session_id", "id", F.col("id").alias("step_id"), "created", times.from_epoch(F.col("created")).alias("ts"), F.when(get("v", "$.role") == "assistant", "agent").otherwise(get("v", "$.role")).alias("source"), "message", get("v", "$.modelID").alias("model"), F.coalesce("is_compaction", F.lit(False)).alias("is_compaction"),
        (get("v", f"{k}.input", "long") + F.coalesce(get("v", f"{k}.cache.read", "long"), F.lit(0))).alias("prompt_tokens"), get("v", f"{k}.output", "long").alias("completion_tokens"), get("v", f"{k}.cache.read", "long").alias("cache_read_tokens"), get("v", f"{k}.cache.write", "long").alias("cache_write_tokens"),
    )
    steps = numbered(steps, ["created", "id"])
    t = p.where(get("v", "$.type") == "tool").join(steps.select("session_id", F.col("id").alias("message_id"), "step_idx"), ["session_id", "message_id"])
    t = t.withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "message_id").orderBy("created", "id")) - 1)
    calls = t.select("session_id", "step_idx", "call_pos", get("v", "$.callID").alias("call_id"), get("v", "$.tool").alias("tool_name"), raw("v", "$.state.input").alias("arguments"))
    results = t.where(get("v", "$.state.status").isin("completed", "error")).select("session_id", get("v", "$.callID").alias("call_id"), F.coalesce(raw("v", "$.state.output"), raw("v", "$.state.error")).alias("content"), (get("v", "$.state.status") == "error").alias("is_error"))
    model = steps.groupBy("session_id").agg(F.max_by("model", F.when(F.col("model").isNotNull(), F.col("step_idx"))).alias("model"))
    sessions = s.join(model, "session_id", "left").select("session_id", "file", "project", "parent_id", "model", times.from_epoch(F.col("created")).alias("created_at"), times.from_epoch(F.col("updated")).alias("updated_at"))
    p_ = tables(agent, sessions, steps, calls, results, unreadable(spark, path, glob, "SELECT 1 FROM session, message, part LIMIT 1"))
    # The call that ran a sub-agent keeps its session's id.
    return with_spawns(p_, t.select("session_id", get("v", "$.callID").alias("call_id"), get("v", "$.state.metadata.sessionId").alias("child")).where("child is not null"))


def session_index(spark: SparkSession, path: str, glob: str = "opencode.db") -> DataFrame:
    """session_id, parent_id, project, title, created_at, updated_at from the table of sessions alone; no message is read."""
    s = table(spark, path, glob, "session", "id string, parent_id string, directory string, title string, time_created long, time_updated long")
    return s.select(F.col("id").alias("session_id"), "parent_id", F.col("directory").alias("project"), "title", times.from_epoch(F.col("time_created")).alias("created_at"), times.from_epoch(F.col("time_updated")).alias("updated_at"))


def todos(spark: SparkSession, path: str, glob: str = "opencode.db") -> DataFrame:
    """session_id, position, content, status, priority of the sessions' to-do lists."""
    return table(spark, path, glob, "todo", "session_id string, position int, content string, status string, priority string").drop("file")


def read_kilo(spark: SparkSession, path: str) -> Parsed:
    return read_opencode(spark, path, "kilo.db", "kilo")


def first_user_messages(spark: SparkSession, path: str, glob: str = "opencode.db") -> DataFrame:
    """session_id, message: the first text part of each session's first user message, found inside SQLite."""
    sql = """SELECT f.session_id, json_extract(p.data, '$.text') FROM
      (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY time_created, id) AS n FROM message WHERE CASE WHEN json_valid(data) THEN json_extract(data, '$.role') END = 'user') f
      JOIN (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY time_created, id) AS k FROM part WHERE CASE WHEN json_valid(data) THEN json_extract(data, '$.type') END = 'text') p ON p.message_id = f.id AND p.k = 1 WHERE f.n = 1"""
    return query(spark, path, glob, sql, "session_id string, message string").drop("file")


def read_cursor(spark: SparkSession, path: str) -> Parsed:
    """Blobs in row order; those that are JSON with a role are messages. A store is a session, named by its folder.

    Sub-agents have no store but a file of lines in the folder `subagents` of their session's
    transcripts; tool results are not in it, and only its first step has a time.
    """
    b = table(spark, path, "store.db", "blobs", "rowid long, data binary").withColumnRenamed("rowid", "pos")
    rows = b.select(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("session_id"), "file", "pos", F.try_parse_json(F.when(F.is_valid_utf8(F.col("data").cast("string")), F.col("data").cast("string"))).alias("v"))
    rows = rows.where("v is not null").withColumn("role", get("v", "$.role")).where("role is not null")
    steps = numbered(rows.where("role <> 'tool'"), ["pos"])
    said = steps.select("session_id", "step_idx", "v", F.coalesce(get("v", "$.id"), F.col("pos").cast("string")).alias("step_id"), F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("source"), text_of("v", "$.content").alias("message"), get("v", "$.providerOptions.cursor.modelName").alias("model"), times.tagged(text_of("v", "$.content")).alias("ts"), F.coalesce(get("v", "$.providerOptions.cursor.isSummary", "boolean"), F.lit(False)).alias("is_compaction"))
    p = steps.select("session_id", "step_idx", F.posexplode(items("v", "$.content")).alias("at", "p")).where(get("p", "$.type") == "tool-call")
    calls = p.withColumn("call_pos", F.row_number().over(W.partitionBy("session_id", "step_idx").orderBy("at")) - 1).select("session_id", "step_idx", "call_pos", get("p", "$.toolCallId").alias("call_id"), get("p", "$.toolName").alias("tool_name"), raw("p", "$.args").alias("arguments"))
    r = rows.where("role = 'tool'").select("session_id", F.explode(items("v", "$.content")).alias("p")).where(get("p", "$.type") == "tool-result")
    results = r.select("session_id", get("p", "$.toolCallId").alias("call_id"), raw("p", "$.result").alias("content"), F.lit(False).alias("is_error"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file"), F.lit(None).cast("string").alias("parent_id"))
    main = tables("cursor", sessions, said, calls, results, unreadable(spark, path, "store.db", "SELECT rowid, data FROM blobs LIMIT 1"))

    place = "/agent-transcripts/([^/]+)/subagents/([^/]+)\\.jsonl$"
    lines, rejected = json_lines(spark, path)
    lines = lines.where(F.regexp_like("file", F.lit(place))).select(F.regexp_extract("file", place, 2).alias("session_id"), F.regexp_extract("file", place, 1).alias("parent_id"), "file", "pos", "v", get("v", "$.role").alias("role"))
    lines = numbered(lines.where("role in ('user', 'assistant')"), ["pos"])
    said = text_of("v", "$.message.content")
    body = F.coalesce(F.nullif(F.regexp_extract(said, "(?s)<user_query>\\s*(.*?)\\s*</user_query>", 1), F.lit("")), said)
    steps = lines.select("session_id", "step_idx", F.concat(F.lit("cursor-child-"), "step_idx").alias("step_id"), F.when(F.col("role") == "user", "user").otherwise("agent").alias("source"), F.when(F.col("step_idx") == 0, times.tagged(said)).alias("ts"), body.alias("message"))
    p = lines.select("session_id", "step_idx", F.posexplode(items("v", "$.message.content")).alias("at", "p")).where(get("p", "$.type") == "tool_use")
    calls = p.select("session_id", "step_idx", (F.row_number().over(W.partitionBy("session_id", "step_idx").orderBy("at")) - 1).alias("call_pos"), get("p", "$.id").alias("call_id"), get("p", "$.name").alias("tool_name"), raw("p", "$.input").alias("arguments"))
    children = lines.groupBy("session_id", "parent_id").agg(F.min("file").alias("file"))
    none = main.results.limit(0)
    sub = tables("cursor", children, steps, calls, none)
    bad = rejected.where(F.regexp_like("file", F.lit(place)))
    return Parsed(*[getattr(main, t).unionByName(getattr(sub, t)) for t in ("sessions", "steps", "calls", "results")], main.rejected.unionByName(bad.select("file", "pos", "value")))


def read_hermes(spark: SparkSession, path: str) -> Parsed:
    """A session's JSONL file, or else its JSON snapshot, with times and token totals from state.db; the totals go to the last step of the agent. state.db also says which session started which.

    These logs know no folder. A session's project is where it was held: the chat that
    sessions.json names (`slack://<chat>`), or else `hermes://` and the platform, which is `local`
    where none is named by the log, the snapshot, sessions.json or state.db, in this order.
    """
    lines, rejected = json_lines(spark, path)
    a = lines.select(F.col("session").alias("session_id"), "file", "pos", "v").where(get("v", "$.role").isNotNull())
    docs = json_documents(spark, path, "session_*.json").select(F.coalesce(get("v", "$.session_id"), F.regexp_replace("session", "^session_", "")).alias("session_id"), "file", F.posexplode(items("v", "$.messages")).alias("i", "v"))
    b = docs.join(a.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "file", F.struct(F.lit(0).cast("long").alias("block"), F.col("i").cast("long").alias("id")).alias("pos"), "v")
    rows = a.unionByName(b).withColumn("role", get("v", "$.role"))
    kept = table(spark, path, "state.db", "sessions", "id string, started_at double, ended_at double, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    state = kept.select(F.col("id").alias("session_id"), F.col("started_at").alias("started"), F.col("ended_at").alias("ended"), F.col("input_tokens").alias("i"), F.col("output_tokens").alias("o"), F.col("cache_read_tokens").alias("r"), F.col("cache_write_tokens").alias("w"))
    # Older tables lack the column, which is why it is asked for by itself.
    parents = table(spark, path, "state.db", "sessions", "id string, parent_session_id string").where("parent_session_id is not null").groupBy(F.col("id").alias("session_id")).agg(F.min("parent_session_id").alias("parent_id"))
    named = [
        lines.where(get("v", "$.role") == "session_meta").select(F.col("session").alias("session_id"), get("v", "$.platform").alias("platform"), get("v", "$.model").alias("model"), F.lit(1).alias("rank")),
        json_documents(spark, path, "session_*.json").select(F.coalesce(get("v", "$.session_id"), F.regexp_replace("session", "^session_", "")).alias("session_id"), get("v", "$.platform").alias("platform"), get("v", "$.model").alias("model"), F.lit(2).alias("rank")),
        table(spark, path, "state.db", "sessions", "id string, source string").select(F.col("id").alias("session_id"), F.col("source").alias("platform"), F.lit(None).cast("string").alias("model"), F.lit(4).alias("rank")),
    ]
    e = json_documents(spark, path, "sessions.json").select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "e"))
    # What is known of the chat lies in the entry or, in newer lists, under `origin`.
    in_entry = lambda k: F.coalesce(get("e", f"$.origin.{k}"), get("e", f"$.{k}"))
    chats = e.select(get("e", "$.session_id").alias("session_id"), in_entry("platform").alias("platform"), in_entry("chat_id").alias("chat")).where("session_id is not null")
    places = chats.select("session_id", "platform", F.lit(None).cast("string").alias("model"), F.lit(3).alias("rank"), "chat")
    for x in named:
        places = places.unionByName(x.withColumn("chat", F.lit(None).cast("string")))
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("rank"))).alias(c)
    places = places.groupBy("session_id").agg(first("platform"), first("model"), first("chat"))
    project = F.when(F.col("platform").isNotNull() & F.col("chat").isNotNull(), F.concat_ws("://", "platform", "chat")).otherwise(F.concat(F.lit("hermes://"), F.coalesce("platform", F.lit("local"))))
    steps = numbered(rows.where("role in ('user', 'assistant', 'system')").select("session_id", "pos", "v", F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("source"), ts_of("v", "$.timestamp").alias("ts"), text_of("v", "$.content").alias("message")), ["pos"])
    last = steps.where("source = 'agent'").groupBy("session_id").agg(F.max("step_idx").alias("step_idx")).join(state, "session_id").select("session_id", "step_idx", (F.col("i") + F.coalesce("r", F.lit(0))).alias("prompt_tokens"), F.col("o").alias("completion_tokens"), F.col("r").alias("cache_read_tokens"), F.col("w").alias("cache_write_tokens"))
    c = steps.select("session_id", "step_idx", F.posexplode(items("v", "$.tool_calls")).alias("call_pos", "c"))
    calls = c.select("session_id", "step_idx", "call_pos", get("c", "$.id").alias("call_id"), F.coalesce(get("c", "$.function.name"), get("c", "$.name")).alias("tool_name"), F.coalesce(raw("c", "$.function.arguments"), raw("c", "$.arguments")).alias("arguments"))
    body = F.try_parse_json(raw("v", "$.content"))
    failed = F.coalesce(get(body, "$.exit_code", "int") != 0, F.lit(False)) | (F.coalesce(get(body, "$.error"), F.lit("")) != "") | F.coalesce(get(body, "$.status") == "error", F.lit(False))
    results = rows.where("role = 'tool'").select("session_id", get("v", "$.tool_call_id").alias("call_id"), text_of("v", "$.content").alias("content"), failed.alias("is_error"))
    sessions = rows.groupBy("session_id").agg(F.min("file").alias("file")).join(state, "session_id", "left").join(parents, "session_id", "left").join(places, "session_id", "left").select("session_id", "file", "parent_id", "model", project.alias("project"), times.from_epoch(F.col("started")).alias("created_at"), times.from_epoch(F.col("ended")).alias("updated_at"))
    return tables("hermes", sessions, steps.join(last, ["session_id", "step_idx"], "left"), calls, results, rejected)
