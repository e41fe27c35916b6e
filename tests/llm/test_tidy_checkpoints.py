"""What checkpoints leave on disk."""

import re
import time

from pyspark.sql import functions as F

from tracemill.llm import common


def test_checkpoints_leave_no_shuffle_files(spark):
    """On check_h the files of all rounds filled the disk."""
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {x for x in re.findall(r"shuffle_\S+", found)}

    grouped = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    setting, before = spark.conf.get(common.TIDY), files()
    out = common.checkpointed(grouped)
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.25)
    assert files() <= before and spark.conf.get(common.TIDY) == setting
    assert sorted(out.collect()) == sorted(grouped.collect()) and sorted(grouped.collect())[0] == (0, 49500)
