"""The bounded sample of labelled texts from which classifiers learn."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scratch


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)


def held_out(doc_id: Column, divisor: int = 4, which: int = 2) -> Column:
    """Whether the crc32 of doc_id as text leaves the remainder that is kept apart from learning; false for a null."""
    return F.coalesce(remainder(doc_id, divisor) == which, F.lit(False))


#: Bytes of a labelled text beyond which it is scored but not learned from, and bytes of all learned texts: the bound of the fitting task.
LEARNED_BYTES, TOTAL_BYTES = 1 << 17, 48 << 20


def fit(docs: DataFrame, labels: DataFrame, label: str, most: int, learn: Callable[[list[str], list[int]], bytes], most_bytes: int = LEARNED_BYTES, total_bytes: int = TOTAL_BYTES) -> bytes:
    """The model that learn(texts, labels) makes in one task from `most` labelled training texts at most.

    The ids are the first by a hash of doc_id among the labelled rows that are not held out and whose label is no
    null; for repeated labels the largest counts, of rows of one id the least text. Texts of more than `most_bytes` among them are left out, and so are those after
    which the texts, in the order of the hash, hold more than `total_bytes`. Held-out labels are never read. Only the model comes to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.groupBy(F.col("doc_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id")
    rows = scratch.cut(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")))

    def run(batches):  # noqa: ANN001, ANN202
        found = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([learn([t for _, t, _ in found], [y for _, _, y in found])], pa.binary())], ["model"])

    size = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    held = rows.select("doc_id", (F.octet_length("text") + 16).alias("bytes")).select("doc_id", size.alias("size")).where(F.col("size") <= total_bytes)  # `most` rows
    model = rows.join(F.broadcast(held), "doc_id").select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").first()
    return bytes(model[0]) if model else learn([], [])  # Spark runs no task for a table that it knows to be empty


def plus(rows: DataFrame, name: str) -> T.StructType:
    """rows' schema with a further column of doubles."""
    return T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
