"""Scans of text, CSV, metadata and result files, and sinks for data sets and indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators.graph import upsert


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a whole file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_csv_as_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each CSV file's lines joined as one text (delimited, not padded like a printed table)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("n"))
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n").alias("text"))


def scan_directory(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files below a directory; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON files by schema, a row a file; a file that is no JSON has its text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Result envelopes, a row a file, newest first: id, title, description, type, created_at, workflow_id, file_size and data (a VARIANT).

    Where a file says nothing, the id is its name without the ending, the title names the id, the type is `unknown` and
    created_at is the file's time. A file that is no JSON is of type `corrupted`, one that holds another value than an object is of type
    `unknown`; both have no data. Ties by id. data keeps whatever the envelope holds: `variant_get(data, '$.a.b', 'int')`.
    """
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    rows = files.withColumn("v", F.try_parse_json("value")).withColumn("name", F.regexp_replace("file_name", r"[.]json$", ""))
    bad, kind = F.col("v").isNull(), F.schema_of_variant("v")
    good = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    of = lambda c: F.when(good, F.try_variant_get("v", f"$.{c}", "string"))
    wrong = F.when(bad, F.lit("File contains invalid JSON")).when(~good, F.lit("Invalid result format"))
    return rows.select(
        F.coalesce(of("id"), "name").alias("id"),
        F.coalesce(of("title"), F.concat(F.when(bad, F.lit("Corrupted Result ")).otherwise(F.lit("Result ")), "name")).alias("title"),
        F.coalesce(wrong, of("description"), F.lit("Workflow result")).alias("description"),
        F.when(bad, F.lit("corrupted")).otherwise(F.coalesce(of("type"), F.lit("unknown"))).alias("type"),
        F.coalesce(of("created_at"), F.date_format("file_modification_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("created_at"),
        of("workflow_id").alias("workflow_id"),
        "file_size",
        F.when(good, F.try_variant_get("v", "$.data", "variant")).alias("data"),
    ).orderBy(F.desc("created_at"), "id")


def first_by_name(*sources: DataFrame) -> DataFrame:
    """The union of sources (name, ..): of rows of one name the one of the first source."""
    every = [s.withColumn("__rank", F.lit(k)) for k, s in enumerate(sources)]
    union = every[0]
    for s in every[1:]:
        union = union.unionByName(s)
    return union.withColumn("__r", F.row_number().over(Window.partitionBy("name").orderBy("__rank"))).where("__r = 1").drop("__r", "__rank")


def write_instructions(rows: DataFrame, path: str) -> None:
    """JSON Lines in partitions."""
    rows.select("instruction", "input", "output").write.mode("overwrite").json(path)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def write_chunk_index(chunks: DataFrame, path: str, buckets: int = 16) -> None:
    """Parquet by a hash bucket of doc_id, so that one document's chunks are found and replaced in one folder. The whole index is written."""
    chunks.withColumn("bucket", _bucket(["doc_id"], buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _merged(new: DataFrame, path: str, keys: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Rewrite the buckets of a table that `new` has rows in as merge(old rows, new rows); other buckets are neither read nor written.

    What is merged is written to the shared folder before a bucket is replaced, so a failed run can be repeated.
    """
    spark = new.sparkSession
    given = tables.cut(new.withColumn("bucket", _bucket(keys, buckets)))
    touched = [r.bucket for r in given.select("bucket").distinct().collect()]  # no more than there are buckets
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        old = spark.read.schema(given.schema).parquet(path).where(F.col("bucket").isin(touched))
        given = tables.cut(merge(old, given).select(*given.columns))
    elif not touched:
        return
    given.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_documents(chunks: DataFrame, path: str, buckets: int = 16) -> None:
    """Put documents' chunks in a chunk index: all that it held of these documents goes. Only their buckets are rewritten; `buckets` is the index's own number."""
    _merged(chunks, path, ["doc_id"], buckets, lambda old, new: old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*new.columns).unionByName(new))


def upsert_table(rows: DataFrame, path: str, keys: list[str], order: str = "updated_at", buckets: int = 16) -> None:
    """Merge rows (of nodes, edges or documents) into a table of hash buckets: the latest of each key by `order` stays. Only touched buckets are rewritten."""
    _merged(rows, path, keys, buckets, lambda old, new: upsert(old, new, keys, order))


def scan_model_registry(spark: SparkSession, path: str, kind: str = "text_generation") -> DataFrame:
    """Models of one type from JSON lines (name, type, strengths, weaknesses, cost, speed)."""
    schema = "name string, type string, strengths array<string>, weaknesses array<string>, cost string, speed string"
    return spark.read.schema(schema).json(path).where(F.col("type") == kind)


def newest_first(rows: DataFrame, at: str = "upload_time", then: str = "id") -> DataFrame:
    """Document metadata or results by time, the newest first, ties by id."""
    return rows.orderBy(F.desc_nulls_last(at), then)


def write_envelopes(results: DataFrame, path: str) -> None:
    """Each result (id, title, description, type, data, created_at, workflow_id) as JSON in path/full, and its data alone in path/data.

    The input is computed once; data may be of any type, a VARIANT too. A second run replaces the first one's files.
    """
    own = tables.cut(results)
    for name, rows in (("full", own), ("data", own.select("id", "data"))):
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{path}/{name}")
