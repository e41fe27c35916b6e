"""Spreading small inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a small file is one split, whatever is computed from it.

    A large input has more splits than cores and is left as it is, without a shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
