"""Batches of documents that ask keyed tables and get their answers back.

Counting keys of all documents and telling every document what was counted needs two exchanges, and a key that is in a
third of all documents would fill one task. Here documents are dealt to batches by a hash. A batch asks for each
distinct key once, as packed arrays, one for each shard of the key space; a shard answers the batch. So a hot key costs a
shard one entry for each batch, not one for each occurrence, and no table is broadcast.

Batches and shards both grow with the root of the input once that makes more than their least sizes. So there is at most
one packed array for each PACKET bytes of text: their number grows in proportion, not with the square.

The documents go through one exchange, as packed tables, and Spark reuses its files whenever a step takes up the batches
again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch

ANSWER = "g long, shard long, body binary"
#: Least bytes of text for each packed array (a pair of a batch and a shard); bytes of text that a task packs at once.
PACKET, PACKED = 1 << 10, 48 << 20


def unit(total: int, least: int) -> int:
    """The bytes of text of a batch or a shard of `total` bytes."""
    return max(least, math.isqrt(total * PACKET))


def shards(docs: DataFrame, total: int, least: int = 8 << 20) -> int:
    return max(scratch.shuffle_width(docs.sparkSession), total // unit(total, least))


def deal(docs: DataFrame, columns: tuple[str, ...] = (), target: int = 12 << 20) -> tuple[DataFrame, int, int]:
    """(packed tables (g, body) of doc_id, text and the carried columns; the number of batches; all bytes of text).

    A batch g holds about `target` bytes of text, or unit(). Rows go by a hash of doc_id and text.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(scratch.shuffle_width(spark), -(-total // unit(total, target)))
    given = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("g"), "doc_id", "text", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= PACKED:
                yield _packed(held)
                held, size = [], 0
        if held:
            yield _packed(held)
        held = []
        scratch.release()

    return given.mapInArrow(run, "g long, body binary").repartition(count, "g"), count, total


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    g = table.column("g").to_numpy()
    order = np.argsort(g, kind="stable")
    cuts = np.flatnonzero(np.diff(g[order], prepend=-1))
    rows = table.drop_columns(["g"])
    out = []
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)], strict=True):
        sink = pa.BufferOutputStream()
        own = rows.take(pa.array(order[a:z])).combine_chunks()
        with pa.ipc.new_stream(sink, own.schema) as stream:
            stream.write_table(own)
        out.append(zstandard.ZstdCompressor(level=1).compress(sink.getvalue()))
    return pa.RecordBatch.from_arrays([pa.array(g[order][cuts]), pa.array(out, pa.binary())], ["g", "body"])


def opened(rows: pa.Table) -> pa.Table:
    """The documents of a batch. Their order is not the same each time."""
    return pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b.as_py())).read_all() for b in rows.column("body")])


def join(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes() + b"".join(parts)


def parts(body: bytes) -> list[bytes]:
    n = int.from_bytes(body[:8], "little")
    at = np.cumsum([8 + 8 * n, *np.frombuffer(body, "<i8", n, 8).tolist()]).tolist()
    return [body[a:z] for a, z in zip(at, at[1:], strict=False)]


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(body: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as gaps, their bytes by significance, so that equal high bytes cost nothing."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(body: bytes) -> np.ndarray:
    planes = unpack(body, "u1").reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").reshape(-1), dtype=np.uint64)


def ask(dealt: DataFrame, fn: Callable[[int, pa.Table], list[tuple[int, bytes]]], answers: DataFrame | None = None) -> DataFrame:
    """The questions (g, shard, body) of every batch: fn(g, rows) or, with answers from before, fn(g, rows, {shard: body})."""

    def table(found: list[tuple[int, bytes]], g: int) -> pa.Table:
        return pa.table({"g": pa.array([g] * len(found), pa.int64()), "shard": pa.array([s for s, _ in found], pa.int64()), "body": pa.array([b for _, b in found], pa.binary())})

    if answers is None:

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            found = table(fn(key[0].as_py(), opened(rows)), key[0].as_py())
            scratch.release()
            return found

        return dealt.groupBy("g").applyInArrow(run, ANSWER)

    def again(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        found = table(fn(key[0].as_py(), opened(rows), bodies(got)), key[0].as_py())
        scratch.release()
        return found

    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(again, ANSWER)


def bodies(got: pa.Table) -> dict[int, bytes]:
    return dict(zip(got.column("shard").to_pylist(), got.column("body").to_pylist(), strict=True))


def answer(asked: DataFrame, count: int, fn: Callable[[int, dict[int, bytes]], dict[int, bytes]]) -> DataFrame:
    """fn(shard, {g: question}) gives {g: answer}; one call for each shard. The answers lie as the `count` batches do, so a union of several of them meets the batches without a further exchange."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        found = fn(shard, dict(zip(rows.column("g").to_pylist(), rows.column("body").to_pylist(), strict=True)))
        scratch.release()
        return pa.table({"g": pa.array(list(found), pa.int64()), "shard": pa.array([shard] * len(found), pa.int64()), "body": pa.array(list(found.values()), pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, ANSWER).repartition(count, "g")
