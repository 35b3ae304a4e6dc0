"""Tables written between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, deleted when the application ends.

    Without that setting a session on one machine gets a folder of its own; on a cluster this is an error, as executors
    don't see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{path.toString()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here, and lost executors cost nothing."""
    return read(df, write(df))


#: Whether Spark deletes the shuffle files of a query as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame) -> str:
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    given = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, True)
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, given)
    return path


def read(like: DataFrame, *paths: str) -> DataFrame:
    """The rows of all paths that write() gave for frames of one schema."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


#: Bytes of texts that a Python worker has as Python strings at once, with what comes of them.
SLICE = 1 << 20


def per_text(df: DataFrame, found: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """The rows (*others, *found(text)) of a table whose last column is a text; schema names and types what found gives.

    A worker turns texts of SLICE bytes in all (or one longer text) into Python strings at once and hands their rows on before the next ones,
    so that it holds one Arrow batch of input and little more, however many rows a task has.
    """
    others = df.columns[:-1]
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(fields)
        for batch in batches:
            at = 0
            lengths = pc.fill_null(pc.binary_length(batch.column(len(others))), 0).to_pylist()
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + lengths[end] <= SLICE) and end - at < 1000:
                    size += lengths[end]
                    end += 1
                rows, places = [], []
                for k, t in enumerate(batch.column(len(others)).slice(at, end - at).to_pylist()):
                    new = found(t)
                    rows += new
                    places += [at + k] * len(new)
                if rows:
                    kept = [batch.column(c).take(pa.array(places, pa.int64())) for c in range(len(others))]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), wanted, strict=True))], [*others, *wanted.names])
                at = end

    carried = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in others)
    return df.mapInArrow(run, carried + schema)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds the place of each row (from 1) in an order over all rows, without a window over all of them.

    A range exchange cuts the order, its parts are numbered each by itself, and the row counts of the parts before, one row for each
    part, are added. The order should have no ties, or their places are not the same each time.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(df.repartitionByRange(parts, *order).withColumn("__run", F.spark_partition_id()))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.groupBy("__run").agg(F.count("*").alias("__n")).select("__run", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__run").orderBy(*order))
    return runs.join(F.broadcast(starts), "__run").withColumn(name, place).select(*df.columns, name)
