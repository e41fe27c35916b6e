"""Writing results: CSV and JSON exports, documents by session, and small result stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the dashboard's CSV, one row for each session.
EXPORT = ("session_id", "project", "agent", "model", "created_at", "updated_at", "messages", "tool_calls", "prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens", "duration", "cost_usd")


def export_rows(rollup: DataFrame) -> DataFrame:
    """All columns as text: ISO times, cost with six places, empty for null."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    made = {"created_at": iso("created_at"), "updated_at": iso("updated_at"), "cost_usd": F.round("cost_usd", 6).cast("string")}
    return rollup.select(*[F.coalesce(made.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in EXPORT])


def write_csv(rollup: DataFrame, path: str) -> None:
    export_rows(rollup).write.mode("overwrite").csv(path, header=True, emptyValue="")


def dashboard_json(**parts: DataFrame) -> DataFrame:
    """One row with a JSON text of all parts, each as an array of its rows. Parts are aggregates, so they are small."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def write_sessions_json(nested: DataFrame, path: str, ids: list[str] | None = None) -> None:
    """One JSON line for each session; ids that don't exist are left out."""
    rows = nested if ids is None else nested.where(F.col("session_id").isin(ids))
    rows.write.mode("overwrite").json(path)


def remove_rows(spark: SparkSession, path: str, to: str, condition) -> None:
    """A table without the rows that meet a condition, written beside the old one: readers of the old one are not disturbed."""
    spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False))).write.mode("errorifexists").parquet(to)


def save_analysis(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def list_analyses(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "analysis_id").limit(limit)


def catalog_table(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with popularity (log of stars over that of the most stars), and the number of items by type."""
    top = items.agg(F.max("stars").alias("top"))
    with_pop = items.join(F.broadcast(top)).withColumn("popularity", F.when(F.col("top") > 0, F.log1p(F.coalesce("stars", F.lit(0))) / F.log1p("top")).otherwise(0.0)).drop("top")
    return with_pop, items.groupBy("type").agg(F.count("*").alias("items"))


def write_catalog(items: DataFrame, path: str) -> None:
    """Items in ranges of their ids, so that a file's statistics tell a reader of one item which file to open."""
    items.repartitionByRange("item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(path)


def find_item(spark: SparkSession, path: str, item_id: str) -> DataFrame:
    """One item with all its columns; the filter reaches the files."""
    return spark.read.parquet(path).where(F.col("item_id") == item_id)


def topics(items: DataFrame) -> DataFrame:
    """The distinct topics of a catalogue in order."""
    return items.select(F.explode("topics").alias("topic")).distinct().orderBy("topic")
