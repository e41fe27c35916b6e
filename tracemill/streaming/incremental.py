"""Keeping tables up to date with files that are added, grow or go, and steps as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators import sets


def file_listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, stamp: name and a stamp of time and length of each file; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.concat_ws("-", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")).alias("stamp"))


def changes(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """file, kind: unchanged, changed, new or removed against the listing of the last run."""
    return sets.change_kind(now, indexed, "file", "stamp")


def fruitless(now: DataFrame, parsed: DataFrame, key: str = "file") -> DataFrame:
    """file, stamp of files that gave no session. Kept with the index they count as unchanged, so that they are not read again before they change."""
    return now.join(parsed.select(key).distinct(), key, "left_anti")


def replaced(old: DataFrame, fresh: DataFrame, diff: DataFrame, key: str = "file") -> DataFrame:
    """old without the rows of changed and removed files, and fresh, which was parsed from the changed and new ones."""
    gone = diff.where("kind in ('changed', 'removed')").select(F.col("file").alias(key))
    return old.join(gone, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_partials(old: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """replaced() for partial aggregates such as tool usage by session, which are then summed as before."""
    return replaced(old, fresh, diff)


def step_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of steps as a stream. A file that grows is not seen again; for those see following.stream()."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_activity(steps: DataFrame, late: str = "2 hours") -> DataFrame:
    """day, tool_name, steps by tumbling days of the step's time; steps later than `late` behind the latest are left out."""
    return steps.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "tool_name").agg(F.count("*").alias("steps")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "tool_name", "steps")


def activity_sessions(steps: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """session_id, start, end, steps of runs of steps without a longer pause than the gap."""
    s = steps.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("steps"))
    return s.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "steps")


def distinct_steps(steps: DataFrame, key: str = "step_id", late: str = "2 hours") -> DataFrame:
    """Steps without those whose id came before, as far back as the watermark remembers."""
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Gives what has come since the last run to sink, batch by batch, and ends. A batch may come twice after a failure, so sink should replace by key."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so that a batch that comes twice replaces itself. current() reads them."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What keep_batches() wrote: for each key the row of its newest batch."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in ("batch", "batch_number")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_number").alias("r"))
    return newest.select("r.*")
