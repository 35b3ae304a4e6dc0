"""What the steps of an operator leave on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tessera.functions import tables


def test_shuffle_files_go_with_their_step(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(tables.CLEANUP, "false")
    out = tables.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while files() - before and time.time() < until:  # Spark deletes them beside the next query
        time.sleep(0.2)
    assert not files() - before
    assert {(x.k, x["count"]) for x in out.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}
    assert spark.conf.get(tables.CLEANUP, "false") == setting
