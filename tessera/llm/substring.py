"""Substring dedup with a count-min prefilter.

First pass: every batch of documents sends the cells of its windows of words to the merged sketch, which overestimates
counts; it learns which of its cells other batches hit too. Second pass: only windows that the sketch estimates to be
repeated, in the batch or elsewhere, are grouped exactly, by 128 bits of hash; none that is
repeated can be lost. Third pass: words covered by a window that also starts in a smaller doc_id go.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm import batches, scratch, words

U64 = np.uint64
DEPTH = 2
#: Odd multipliers from which the weights of a window's words are made: any two odd numbers with well mixed bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Least cells of one shard of a sketch row (one byte each in a merging task); with the root of the input they become more.
SHARD_BITS = 22
#: Bytes of text of a batch, about: a task holds some thirty times as much in arrays of its windows.
BATCH = 6 << 20


def _windows(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, bound, first, second): rows in the order of doc_id, each one's range of windows, two hashes of each window."""
    order = np.asarray(pc.sort_indices(rows.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end"))
    text = rows.column("text").take(pa.array(order))
    counts, one, two = [], [], []
    weights = [words.mix(np.arange(1, size + 1, dtype=U64) * U64(b)) | U64(1) for b in BASES]
    for _, _, data, offsets in words.texts(text):
        w = words.split(data, offsets, lower=False)
        n = np.diff(w.bound)
        counts.append(np.maximum(0, n - size + 1))
        hashes = w.digests().T
        total = max(0, len(w.start) - size + 1)
        mixed = []
        for h, c in zip(hashes, weights, strict=True):
            s = np.zeros(total, dtype=U64)
            for k in range(size):
                s += h[k : k + total] * c[k]
            mixed.append(words.mix(s))
        whole = np.ones(total, dtype=bool)  # windows that lie in one text
        for e in w.bound[1:-1]:
            whole[max(0, e - size + 1) : e] = False
        one.append(mixed[0][whole])
        two.append(mixed[1][whole])
    none = np.zeros(0, dtype=U64)
    bound = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, dtype=np.int64)
    return order, bound.astype(np.int64), np.concatenate([none, *one]), np.concatenate([none, *two])


def _cells(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each window in each row of the sketch; row r is kept in the cells from r * 2**bits on."""
    return [(words.mix(first + U64(r) * second) >> U64(64 - bits)) + U64(r << bits) for r in range(DEPTH)]


def _by_shard(values: np.ndarray, shift: int) -> list[tuple[int, np.ndarray]]:
    """Ascending values by their high bits."""
    if not len(values):
        return []
    high = values >> U64(shift)
    cuts = np.flatnonzero(high[1:] != high[:-1]) + 1
    return [(int(part[0] >> U64(shift)), part) for part in np.split(values, cuts)]


def _ask_cells(rows: pa.Table, size: int, bits: int, low: int) -> list[tuple[int, bytes]]:
    _, _, first, second = _windows(rows, size)
    out = []
    for cells in _cells(first, second, bits):
        for shard, part in _by_shard(words.distinct(cells), low):
            out.append((shard, batches.pack_sorted(part & U64((1 << low) - 1))))
    return out


def _merge(asked: dict[int, bytes], low: int) -> dict[int, bytes]:
    """For each batch, a bit for each of its cells: whether another batch hits it too."""
    count = np.zeros(1 << low, dtype=np.uint8)
    cells = {g: batches.unpack_sorted(b) for g, b in asked.items()}
    for c in cells.values():
        count[c] = np.minimum(count[c] + 1, 2)  # a batch sends a cell once
    return {g: batches.pack(np.packbits(count[c] > 1)) for g, c in cells.items()}


def _groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): windows sorted by both hashes, then place; where each group of equal ones starts in that order."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort([second, first])
        a, b = first[order], second[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def _ids(rows: pa.Table, order: np.ndarray) -> np.ndarray:
    return np.asarray(rows.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).max))[order]


def _ask_windows(rows: pa.Table, got: dict[int, bytes], size: int, bits: int, low: int, shards: int) -> list[tuple[int, bytes]]:
    order, bound, first, second = _windows(rows, size)
    maybe = np.ones(len(first), dtype=bool)
    for cells in _cells(first, second, bits):
        own, back, count = np.unique(cells, return_inverse=True, return_counts=True)
        flags = [np.unpackbits(batches.unpack(got[s], "u1"), count=len(part)) for s, part in _by_shard(own, low)]
        maybe &= ((np.concatenate(flags) if flags else np.zeros(0)) > 0)[back] | (count > 1)[back]
    at = np.flatnonzero(maybe)
    sort, starts = _groups(first[at], second[at])
    lead = np.sort(at[sort[starts]])  # the first window of each group, in the order of documents
    doc = _ids(rows, order)[np.searchsorted(bound, lead, "right") - 1]
    shard = (second[lead] >> U64(40)) % U64(shards)
    out = []
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        body = [first[lead[mine]].tobytes(), second[lead[mine]].tobytes(), batches.pack_sorted(lead[mine].astype(U64)), batches.pack(np.diff(doc[mine], prepend=0))]
        out.append((int(s), np.array([len(mine), len(body[2])], dtype="<i8").tobytes() + b"".join(body)))
    return out


def _read(body: bytes) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    n, size = np.frombuffer(body, "<i8", 2).tolist()
    at = 16 + 16 * n
    return np.frombuffer(body, "<u8", n, 16), np.frombuffer(body, "<u8", n, 16 + 8 * n), body[at : at + size], np.cumsum(batches.unpack(body[at + size :], "<i8"))


def _settle(asked: dict[int, bytes]) -> dict[int, bytes]:
    """For each batch, the places of its windows that start in a smaller doc_id of another batch."""
    parts = [(g, *_read(b)) for g, b in asked.items()]
    first, second, doc = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 4))
    order, starts = _groups(first, second)
    least = np.minimum.reduceat(doc[order], starts) if len(order) else doc
    later = np.zeros(len(doc), dtype=bool)
    later[order] = doc[order] > np.repeat(least, np.diff(starts, append=len(order)))
    out, at = {}, 0
    for g, a, _, places, _ in parts:
        found = batches.unpack_sorted(places)[later[at : at + len(a)]]
        at += len(a)
        out[g] = batches.pack_sorted(found)
    return out


def _strip(rows: pa.Table, got: dict[int, bytes], size: int, whole: bool) -> tuple[np.ndarray, list[int], list[int], list[str]]:
    """(order, words, removed words, kept text) of each row in the order of doc_id."""
    order, bound, first, second = _windows(rows, size)
    ids = _ids(rows, order)
    hit = np.zeros(len(first), dtype=bool)
    for body in got.values():
        hit[batches.unpack_sorted(body).astype(np.int64)] = True
    sort, starts = _groups(first, second)
    if len(sort):
        doc = ids[np.searchsorted(bound, sort, "right") - 1]
        many = np.diff(starts, append=len(sort))
        gone = (doc > np.repeat(np.minimum.reduceat(doc, starts), many)) | np.repeat(np.logical_or.reduceat(hit[sort], starts), many)
        hit[sort] = gone
    n_words, n_removed, kept = [], [], []
    for k, text in enumerate(rows.column("text").take(pa.array(order)).to_pylist()):
        own = (text or "").encode("utf-8", "surrogatepass").split()
        mine = hit[bound[k] : bound[k + 1]]
        n_words.append(len(own))
        if mine.any():
            over = np.zeros(len(own) + 1, dtype=np.int64)
            at = np.flatnonzero(mine)
            np.add.at(over, at, 1)
            np.add.at(over, at + size, -1)
            keep = np.cumsum(over[:-1]) == 0
            own = list(compress(own, keep.tolist()))
        n_removed.append(n_words[-1] - len(own))
        kept.append(text if whole and not mine.any() else b" ".join(own).decode("utf-8", "surrogatepass"))
    return order, n_words, n_removed, kept


def dedup_substrings(docs: DataFrame, size: int = 13, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the carried columns, one row for each row of docs.

    A window is `size` consecutive words of one document; each word goes that is covered by a window whose words also
    start in a document with a smaller doc_id, judged on the input. Kept words are joined by one space; with
    `whole` a text that loses nothing stays as it is, white space included. A null text has
    no words and an empty kept text; texts shorter than a window stay whole. A null doc_id counts as larger than any
    other; rows with one doc_id don't remove from each other. An empty table gives no rows. Windows of very long texts
    are all used. doc_id must be an integer; windows are equal if 128 bits of hash are. Columns that are not carried are not read; a carried column must not have a name given above.
    """
    rows, count, total = batches.deal(docs, carry, BATCH)
    bits = max(SHARD_BITS, int(total).bit_length())  # about thirteen cells in both rows for each window
    low = min(bits, max(SHARD_BITS, batches.unit(total, 0).bit_length()))
    shards = batches.shards(docs, total)
    cells = batches.answer(batches.ask(rows, lambda g, t: _ask_cells(t, size, bits, low)), count, lambda s, asked: _merge(asked, low))
    asked = batches.ask(rows, lambda g, t, got: _ask_windows(t, got, size, bits, low, shards), cells)
    settled = batches.answer(asked, count, lambda s, asked: _settle(asked))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = batches.opened(left)
        order, n_words, n_removed, kept = _strip(left, batches.bodies(right), size, whole)
        scratch.release()
        moved = left.take(pa.array(order))
        out = {"doc_id": moved.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
        return pa.table(out | {c: moved.column(c) for c in carry})

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(["doc_id " + kinds["doc_id"], "n_words long", "n_removed long", "kept_text string", *(f"`{c}` {kinds[c]}" for c in carry)])
    return rows.groupBy("g").cogroup(settled.groupBy("g")).applyInArrow(run, schema)
