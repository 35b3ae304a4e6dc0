"""A corpus pipeline: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Run it with ``run``.
The stages lower the session's limit on the bytes of an Arrow batch.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, quality, scratch, simhash, substring
from tessera.llm.bpe import bpe_encode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c in COLUMNS[2:])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier accepts (a probability of 0.7 or more)."""
    scratch.bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.with_decision(quality.quality_scores(docs, labels, _others(docs)), 0.7)
    return scored.where("predicted = 1").select("doc_id", "text", *_others(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8), once. Rows without doc_id stay, and so do rows of one doc_id with different texts."""
    scratch.bound_batches(spark)
    groups = simhash.near_duplicates(docs, shingle=5, similarity=0.8)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select("doc_id", "text", *_others(docs))
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words in windows of 13 that an earlier document has; texts that lose nothing stay as they are."""
    scratch.bound_batches(spark)
    found = substring.dedup_substrings(docs, 13, _others(docs), whole=True)
    out = found.withColumn("text", F.col("kept_text"))
    if "n_chars" in _others(docs):
        out = out.withColumn("n_chars", F.length("kept_text").cast("long"))
    return out.select("doc_id", "text", *_others(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item. Rows without doc_id cannot be named and stay."""
    scratch.bound_batches(spark)
    hits = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text", *_others(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the text that they decode to."""
    scratch.bound_batches(spark)
    carry = tuple(c for c in _others(docs) if c != "n_chars")
    found = bpe_encode(docs, RANK_FILE, public_tokenizers.PATTERN, carry)
    return found.select("doc_id", *carry, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]
#: SQL cannot express a trained classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
