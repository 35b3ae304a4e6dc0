"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, labelled, periodic, prefix_trie, quality, token_counts, toxicity
from tessera.llm.ann import nearest
from tessera.llm.bpe import bpe_encode
from tessera.llm.licenses import license_scan
from tessera.llm.lm_trie import lm_scores
from tessera.llm.sharding import hilbert_shards
from tessera.llm.simhash import simhash_components
from tessera.llm.substring import dedup_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts along a Hilbert curve."""
    return hilbert_shards(_table(spark, sf_dir, "documents"), shards=40)


def op2_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by the trie of the training documents."""
    return lm_scores(_table(spark, sf_dir, "documents"))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by two compression dictionaries."""
    found = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.with_decision(found, 0.3).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the token ids of all documents and of the bytes that they decode to."""
    import public_tokenizers

    found = bpe_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by hashed n-grams."""
    found = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.with_decision(found, 0.7).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of all documents."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links."""
    found = simhash_components(_table(spark, sf_dir, "documents"), shingle=3, radius=3, segments=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op8_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items that share a passage."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of an earlier document, as counts and a hash."""
    found = dedup_substrings(_table(spark, sf_dir, "documents"), size=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents (one in ten made periodic first), the strongest one and hashes of all and of the words kept."""
    return periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt with shared first turns."""
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations"))))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of all documents by the word-level BPE vocabulary."""
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_sharding": op1_hilbert_sharding,
    "op2_lm_trie": op2_lm_trie,
    "op3_compression_toxicity": op3_compression_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_stable_projection_ann": op8_stable_projection_ann,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op9_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op10_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents
), t AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)
), f AS (
  SELECT g, min(doc_id) AS least FROM t GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS j FROM t JOIN f USING (g), unnest(range(0, 13)) AS o(k) WHERE doc_id > least
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) AS a
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = a.doc_id AND gone.j = a.j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
