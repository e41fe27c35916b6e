"""Unions, differences and first-wins choices over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order, which should be total. A row with a blank or null key is never a duplicate."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    names = [F.col(c) for c in rows.columns]
    # One aggregation with map-side combining; a window would sort every key's rows.
    best = rows.where(~blank).groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r")).select("r.*")
    return best.unionByName(rows.where(blank))


def union_first_wins(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union of tables in which the earlier table's row wins for a key."""
    ranked = None
    for i, p in enumerate(parts):
        r = p.withColumn("__rank", F.lit(i))
        ranked = r if ranked is None else ranked.unionByName(r)
    return first_by(ranked, keys, [F.col("__rank"), *order]).drop("__rank")


def difference(now: DataFrame, before: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of now that before lacks, and rows of before that now lacks."""
    return now.join(before.select(*keys), keys, "left_anti"), before.join(now.select(*keys), keys, "left_anti")


def change_kind(now: DataFrame, before: DataFrame, key: str, stamp: str) -> DataFrame:
    """key and kind: unchanged, changed, new or removed, by a full outer join on the key."""
    a, b = now.select(F.col(key), F.col(stamp).alias("n")), before.select(F.col(key), F.col(stamp).alias("o"))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("n").eqNullSafe(F.col("o")), "unchanged").otherwise("changed")
    return a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), key, "full").select(key, kind.alias("kind"))


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def mode_first(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most common value of each key, ties to the value seen first."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def gather_orphans(calls: DataFrame, results: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Calls without a result and results without a call."""
    return difference(calls, results, keys)


def pages(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of an ordered table; limit 0 or less is no limit. order should be total."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit > 0 else out


def top_by_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
