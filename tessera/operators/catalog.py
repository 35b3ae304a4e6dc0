"""Document catalog: metadata, validation, token statistics, context windows, collections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import glob_to_regex, word_count

# Fixed values.
EXTENSIONS = (".txt", ".csv", ".pdf", ".md", ".json", ".xml")
MAX_BYTES = 100 * 1024 * 1024
MIME = {".txt": "text/plain", ".csv": "text/csv", ".pdf": "application/pdf", ".md": "text/markdown", ".json": "application/json", ".xml": "application/xml"}
CONTEXT_WINDOWS = {
    "gpt-3.5-turbo": 4096,
    "gpt-3.5-turbo-16k": 16384,
    "gpt-4": 8192,
    "gpt-4-32k": 32768,
    "gpt-4-turbo": 128000,
    "claude-instant": 100000,
    "claude-2": 100000,
    "llama-2-7b": 4096,
    "llama-2-13b": 4096,
    "llama-2-70b": 4096,
    "mistral-7b": 8192,
    "mixtral-8x7b": 32768,
    "gemma-7b": 8192,
    "phi-3": 4096,
    "qwen-7b": 8192,
    "codellama": 16384,
}


def extension(name: Column) -> Column:
    """The last suffix of a file name in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def validate(files: DataFrame, name: str = "filename", size: str = "size") -> DataFrame:
    """Adds valid and reason (null if valid): extension first, then size."""
    ext = extension(F.col(name))
    reason = F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("Unsupported file type: "), ext)).when(F.col(size) > MAX_BYTES, F.format_string(f"File too large: %d bytes (max: {MAX_BYTES})", F.col(size)))
    return files.withColumns({"valid": reason.isNull(), "reason": reason})


def include_filter(files: DataFrame, glob: str | None = None, name: str = "filename", size: str = "size") -> DataFrame:
    """The files of a known extension, a name that fits the glob, and an allowed size."""
    keep = extension(F.col(name)).isin(*EXTENSIONS) & (F.col(size) <= MAX_BYTES)
    return files.where(keep & F.regexp_extract(F.col(name), r"[^/]*$", 0).rlike(glob_to_regex(glob)) if glob else keep)


def metadata(files: DataFrame, name: str = "filename") -> DataFrame:
    """Adds type (extension in upper case or UNKNOWN) and mime_type by extension."""
    ext = extension(F.col(name))
    kinds = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return files.withColumns({"type": F.when(ext == "", "UNKNOWN").otherwise(F.upper(F.substring(ext, 2, 100))), "mime_type": F.coalesce(F.get(F.array(kinds), F.lit(0))[ext], F.lit("application/octet-stream"))})


def token_count(text: Column) -> Column:
    """Tokens estimated as 1.3 for each word, rounded down."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, characters, words and error; an empty or null text is an error with zeros."""
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    zero = lambda c: F.when(empty, F.lit(0)).otherwise(c).cast("long")
    return docs.select("doc_id", zero(token_count(F.col("text"))).alias("token_count"), zero(F.length("text")).alias("character_count"), zero(word_count(F.col("text"))).alias("word_count"), F.when(empty, "No text content found").alias("error"))


def corpus_summary(stats: DataFrame) -> DataFrame:
    """One row: totals over documents without an error, and how many there are of either kind."""
    good = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(f"total_{c}s")
    return stats.agg(total("token_count"), total("character_count"), total("word_count"), F.count("*").alias("total_documents"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))


def window_usage(rows: DataFrame, tokens: str = "token_count", window: str = "context_window") -> DataFrame:
    """Adds usage_percentage (two decimals, exact halves go up), remaining_tokens, status and fits_in_context."""
    used = F.col(tokens) / F.col(window) * 100
    status = F.when(used < 50, "low").when(used < 80, "medium").when(used < 95, "high").otherwise("critical")
    return rows.withColumns({"usage_percentage": F.expr(f"({tokens} * 20000 + {window}) div ({window} * 2)") / 100, "remaining_tokens": F.greatest(F.lit(0), F.col(window) - F.col(tokens)), "status": status, "fits_in_context": F.col(tokens) <= F.col(window)})


def window_matrix(stats: DataFrame) -> DataFrame:
    """Every document with every model's context window: a constant number of rows for each document."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("context_window")) for m, w in CONTEXT_WINDOWS.items()])
    return window_usage(stats.select("doc_id", "token_count", F.inline(models)))


def format_tokens(n: Column) -> Column:
    """A number with its unit; halves of the last digit go up."""
    tenths = lambda unit: F.floor((n + unit // 20) / (unit // 10)) / 10
    return F.when(n < 1000, F.format_string("%d tokens", n)).when(n < 1_000_000, F.format_string("%.1fK tokens", tenths(1000))).otherwise(F.format_string("%.1fM tokens", tenths(1_000_000)))


def format_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with at most two decimals."""
    step = F.least(F.lit(3), F.floor(F.ln(F.greatest(size, F.lit(1))) / math.log(1024))).cast("int")
    number = F.round(size / F.pow(F.lit(1024.0), step), 2)
    return F.when(size == 0, "0 B").otherwise(F.concat_ws(" ", number.cast("string"), F.get(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step)))


def lookup(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def collection_stats(members: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents, tokens and characters of each collection (collection_id, doc_id); unknown documents count nothing."""
    return members.join(stats, "doc_id").groupBy("collection_id").agg(F.count("*").alias("document_count"), F.sum("token_count").alias("total_tokens"), F.sum("character_count").alias("total_size"))


def collection_add(members: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The members and those wanted (collection_id, doc_id) that exist and are not members yet."""
    keys = ["collection_id", "doc_id"]
    new = wanted.select(*keys).distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").join(members, keys, "left_anti")
    return members.select(*keys).unionByName(new.select(*keys))


def collection_remove(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("collection_id", "doc_id").distinct(), ["collection_id", "doc_id"], "left_anti")


def collection_delete(docs: DataFrame, members: DataFrame, collection: str) -> DataFrame:
    """The documents left when a collection and its documents are deleted."""
    return docs.join(members.where(F.col("collection_id") == collection).select("doc_id").distinct(), "doc_id", "left_anti")


def collection_list(collections: DataFrame) -> DataFrame:
    return collections.orderBy(F.desc("updated_at"), "collection_id")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of the columns of two one-row tables, as <column>_delta."""
    cols = before.columns
    old = before.select(*[F.col(c).alias(f"__{c}") for c in cols])
    return after.join(F.broadcast(old), F.lit(True)).select(*[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_delta") for c in cols])
