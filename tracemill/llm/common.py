"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import durable
from tracemill.durable import shared_folder

__all__ = ["CRC_TABLE_SQL", "KEY", "SPACE_CLASS", "checkpointed", "crc_bucket", "crc_sql", "free_prefix", "row_key", "shared_folder", "slices", "table", "words_of"]

#: A word is a run of characters other than space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Drops the shuffle files of a query at its end, rather than when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """durable.checkpointed() that leaves no shuffle files behind: nobody reads them once the rows are written.

    Jobs of many rounds would else keep the files of all rounds on disk.
    """
    spark = df.sparkSession
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        # As a frame of its own: the setting holds for frames made under it, and df's files stay for who else runs df.
        return durable.checkpointed(df.select("*"))
    finally:
        spark.conf.set(TIDY, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Document order: id, null last, then a 128-bit key of the text; rows equal in both are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_ = F.col(id_col).cast("long")
    return [id_.isNull().alias("d0"), F.coalesce(id_, F.lit(0)).alias("d1"), F.xxhash64(text).alias("d2"), F.xxhash64(F.lit(1), text).alias("d3")]


#: Names of the columns of row_key().
KEY = ["d0", "d1", "d2", "d3"]


def free_prefix(df: DataFrame) -> str:
    """A beginning of column names that no column of df has."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one slice has about max_bytes of the column's text, and a row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string()).cast(pa.large_binary())), 0)
        ends = np.cumsum(np.asarray(size, dtype=np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + max_bytes, side="right"))
            to = min(max(to, at + 1), at + max_rows, n)
            yield batch.slice(at, to - at)
            at = to


#: crc32 of a list of bytes, b, in SQL: the table's entries by the polynomial, then a step for each byte.
CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc_sql(text: str, table: str) -> str:
    """SQL for the crc32 of a text, given the name of the column that holds CRC_TABLE_SQL."""
    as_bytes = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda j: CAST('0x' || hex(encode({text}))[2 * j + 1:2 * j + 2] AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {as_bytes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"
