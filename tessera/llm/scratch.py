"""Tables written between the steps of one operator, in the folder that all executors share, and what tasks hold."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

from tessera.functions.tables import cut, shared_dir

__all__ = ["bound_batches", "cut", "release", "shared_dir", "shuffle_width"]

#: Bytes of an Arrow batch, about, that bound_batches lets Spark give to a Python worker.
BATCH_BYTES = 4 << 20


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES instead of Spark's 64 MB, unless the session has a lower limit: executor and worker both hold each batch."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(limit))
    if now > BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)


def release() -> None:
    """Give what this worker has freed back to the system: a worker stays for a minute after its task, beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
