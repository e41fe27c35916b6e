"""Edges between tool calls of a session, by windows over the calls in order.

calls has session_id, idx (order within the session), call_id, tool_name, path, is_error.
A session's calls are together in one task; sessions are many and bounded in length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions.tools import category

READ_WRITE, SEARCH_READ, WRITE_TEST, RETRY = 20, 12, 5, 6
EDGE = ["session_id", "source_id", "target_id", "relation", "resource"]


def numbered(steps: DataFrame) -> DataFrame:
    """Calls of steps that have one tool_name each, numbered from 0 in step order; calls without an id are left out."""
    w = W.partitionBy("session_id").orderBy("step_idx")
    return steps.where("tool_name is not null and step_id is not null").select("session_id", (F.row_number().over(w) - 1).alias("idx"), F.col("step_id").alias("call_id"), "tool_name", "path", "is_error")


def _edge(df: DataFrame, relation: str, resource) -> DataFrame:
    return df.select("session_id", F.col("src.call_id").alias("source_id"), F.col("call_id").alias("target_id"), F.lit(relation).alias("relation"), resource.alias("resource"))


def _last(cond, *cols):
    """The struct of the last row before this one that meets cond."""
    return F.last(F.when(cond, F.struct(*cols)), ignorenulls=True)


def read_before_write(calls: DataFrame) -> DataFrame:
    """The latest read of a path before a write of it, at most 20 calls earlier."""
    w = W.partitionBy("session_id", "path").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    kind = category(F.col("tool_name"))
    c = calls.where("path <> ''").withColumn("kind", kind).withColumn("src", _last(F.col("kind") == "file_read", "call_id", "idx").over(w))
    return _edge(c.where((F.col("kind") == "file_write") & (F.col("idx") - F.col("src.idx") <= READ_WRITE)), "read_before_write", F.col("path"))


def search_then_read(calls: DataFrame) -> DataFrame:
    """The latest search before a read, at most 12 calls earlier, with nothing but searches, reads and other tools between."""
    w = W.partitionBy("session_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    c = calls.withColumn("kind", category(F.col("tool_name"))).withColumn("src", _last(~F.col("kind").isin("file_read", "other"), "call_id", "idx", "kind").over(w))
    return _edge(c.where("kind = 'file_read' and src.kind = 'search'").where(F.col("idx") - F.col("src.idx") <= SEARCH_READ), "search_then_read", F.coalesce("path", F.lit("")))


def write_then_test(calls: DataFrame) -> DataFrame:
    """A shell call and the write before it, at most 5 calls earlier, with nothing but other tools between.

    A write is used once: a shell call between the two would have taken it, being nearer.
    """
    w = W.partitionBy("session_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    c = calls.withColumn("kind", category(F.col("tool_name"))).withColumn("src", _last(F.col("kind") != "other", "call_id", "idx", "kind", "path").over(w))
    return _edge(c.where("kind = 'shell' and src.kind = 'file_write'").where(F.col("idx") - F.col("src.idx") <= WRITE_TEST), "write_then_test", F.coalesce("src.path", F.lit("")))


def multi_edit(calls: DataFrame) -> DataFrame:
    """Each write of a path and the write of it before."""
    w = W.partitionBy("session_id", "path").orderBy("idx")
    c = calls.where("path <> ''").where(category(F.col("tool_name")) == "file_write").withColumn("src", F.struct(F.lag("call_id").over(w).alias("call_id")))
    return _edge(c.where("src.call_id is not null"), "multi_edit", F.col("path"))


def _retries(calls: DataFrame) -> DataFrame:
    """session_id, source_id, target_id, target_idx of the edges of error_retry()."""
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        t = pa.Table.from_batches(list(batches))
        rows = sorted(t.to_pylist(), key=lambda r: r["idx"])
        taken, out = set(), []
        for i, r in enumerate(rows):
            if r["is_error"] and i not in taken:
                j = next((j for j in range(i + 1, min(i + 1 + RETRY, len(rows))) if j not in taken and rows[j]["tool_name"] == r["tool_name"]), None)
                if j is not None:
                    taken.add(j)
                    out.append((r["session_id"], r["call_id"], rows[j]["call_id"], rows[j]["idx"]))
        cols = [pa.array([x[i] for x in out], t.schema.field(n).type) for i, n in enumerate(("session_id", "call_id", "call_id", "idx"))]
        yield pa.RecordBatch.from_arrays(cols, names=["session_id", "source_id", "target_id", "target_idx"])

    w = W.partitionBy("session_id").orderBy("idx")
    error = F.coalesce(F.col("is_error").cast("boolean"), F.lit(False))
    few = calls.select("session_id", "idx", "call_id", "tool_name", "is_error", F.coalesce(F.max(error).over(w.rowsBetween(-RETRY, -1)), F.lit(False)).alias("near"))
    few = few.withColumn("run", F.sum(F.when(F.col("near"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return few.where(F.col("near") | error).drop("near").groupBy("session_id", "run").applyInArrow(run, f"session_id {kinds['session_id']}, source_id {kinds['call_id']}, target_id {kinds['call_id']}, target_idx {kinds['idx']}")


def error_retry(calls: DataFrame) -> DataFrame:
    """A failed call and the next call of the same tool within 6 calls. A call is the target of one edge, and then starts none.

    Which call is taken depends on what was taken before, so calls are gone through in order,
    in runs: a new one starts where none of the 6 calls before failed, as no edge leads past
    that place, and calls that no failure reaches are left out.
    """
    return _retries(calls).select("session_id", "source_id", "target_id", F.lit("error_retry").alias("relation"), F.lit("").alias("resource"))


def sequential(calls: DataFrame, strong: DataFrame) -> DataFrame:
    """The call before, for each call that no stronger edge leads to."""
    w = W.partitionBy("session_id").orderBy("idx")
    c = calls.withColumn("src", F.struct(F.lag("call_id").over(w).alias("call_id"))).where("src.call_id is not null")
    seen = strong.select(F.col("session_id").alias("s"), F.col("target_id").alias("t")).distinct()
    return _edge(c.join(seen, F.expr("session_id = s and call_id = t"), "left_anti"), "sequential", F.lit(""))


def all_edges(calls: DataFrame) -> DataFrame:
    """The edges of all kinds: sequential ones only where no other leads to the call.

    One exchange by session serves all windows; each call carries the edges that lead to it.
    """
    c = calls.repartition("session_id").withColumn("kind", category(F.col("tool_name")))
    by_path = W.partitionBy("session_id", "path").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("session_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    kind, idx = F.col("kind"), F.col("idx")
    named = F.col("path") != ""
    c = c.withColumn("read", _last(named & (kind == "file_read"), "call_id", "idx").over(by_path)).withColumn("write", _last(named & (kind == "file_write"), "call_id").over(by_path))
    c = c.withColumn("turn", _last(~kind.isin("file_read", "other"), "call_id", "idx", "kind").over(before)).withColumn("work", _last(kind != "other", "call_id", "idx", "kind", "path").over(before)).withColumn("prev", F.last("call_id").over(before))
    retry = _retries(calls.repartition("session_id")).select("session_id", F.col("source_id").alias("retried"), F.col("target_idx").alias("idx"))
    c = c.join(retry, ["session_id", "idx"], "left")
    edge = lambda when, source, relation, resource: F.when(when, F.struct(F.col(source).alias("source_id"), F.lit(relation).alias("relation"), resource.alias("resource")))
    path = F.coalesce("path", F.lit(""))
    strong = F.filter(
        F.array(
            edge(named & (kind == "file_write") & (idx - F.col("read.idx") <= READ_WRITE), "read.call_id", "read_before_write", path),
            edge((kind == "file_read") & (F.col("turn.kind") == "search") & (idx - F.col("turn.idx") <= SEARCH_READ), "turn.call_id", "search_then_read", path),
            edge((kind == "shell") & (F.col("work.kind") == "file_write") & (idx - F.col("work.idx") <= WRITE_TEST), "work.call_id", "write_then_test", F.coalesce("work.path", F.lit(""))),
            edge(named & (kind == "file_write") & F.col("write").isNotNull(), "write.call_id", "multi_edit", path),
            edge(F.col("retried").isNotNull(), "retried", "error_retry", F.lit("")),
        ),
        lambda e: e.isNotNull(),
    )
    plain = F.filter(F.array(edge(F.col("prev").isNotNull(), "prev", "sequential", F.lit(""))), lambda e: e.isNotNull())
    c = c.select("session_id", F.col("call_id").alias("target_id"), strong.alias("strong"), plain.alias("plain"))
    return c.select("session_id", "target_id", F.explode(F.when(F.size("strong") > 0, F.col("strong")).otherwise(F.col("plain"))).alias("e")).select("session_id", "e.source_id", "target_id", "e.relation", "e.resource")


def roots(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls that no edge leads to."""
    return calls.join(edges.select("session_id", F.col("target_id").alias("call_id")).distinct(), ["session_id", "call_id"], "left_anti").select("session_id", "call_id")
