"""Runs of periodic words: descending-LCP Kruskal over the suffixes of a text's words.

Suffixes in order make a path whose edges weigh the words that neighbours share (LCP). Edges unite suffix classes by
decreasing weight; a class keeps its positions in order. Two positions that become neighbours in their class when it is
united at LCP v share v words exactly, so at a distance d within v they seed a run of period d that ends v words after the
second one. The first two periods of every run become neighbours in this way, at the run's own period: a position between
them in the class would give the run a smaller period.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words

#: Positions in one block of an ordered set: an insertion moves no more than these.
BLOCK = 1024
_RUN = "runs array<struct<start:bigint,length:bigint,period:bigint>>"


class Positions:
    """An ordered set of positions, in blocks of bounded size."""

    __slots__ = ("blocks", "size", "tops")

    def __init__(self, first: int, second: int) -> None:
        self.blocks = [[first, second] if first < second else [second, first]]
        self.tops = [self.blocks[0][1]]
        self.size = 2

    def add(self, x: int) -> tuple[int, int]:
        """Put x in; (the position before it, the position after it), -1 where there is none."""
        blocks, tops = self.blocks, self.tops
        k = bisect_left(tops, x)
        self.size += 1
        if k == len(tops):
            k -= 1
            own = blocks[k]
            before, after = own[-1], -1
            own.append(x)
            tops[k] = x
        else:
            own = blocks[k]
            at = bisect_left(own, x)
            after = own[at]
            before = own[at - 1] if at else blocks[k - 1][-1] if k else -1
            own.insert(at, x)
        if len(own) > BLOCK:
            half = len(own) // 2
            blocks[k : k + 1] = [own[:half], own[half:]]
            insort(tops, own[half - 1])
        return before, after

    def __iter__(self) -> Iterator[int]:
        for own in self.blocks:
            yield from own


def _sorted_suffixes(word: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, the LCP of each with the one before), without those that share fewer than `least` words with any other.

    word: the words as numbers, different ones in different texts; last[i]: the end of the text of word i. Ranks by the
    first 1, 2, 4, .. words double until no two suffixes are equal (4 bytes for each word and doubling). A rank is the place
    of the first of its equals, so a group is refined on its own and a suffix that stands alone keeps its rank.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    by = word[order]
    head = np.maximum.accumulate(np.where(np.append(True, by[1:] != by[:-1]), np.arange(n), 0)) if n else by
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    levels, length, kept = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1, None
    live = order[_shared(head)]
    while len(live):
        if kept is None and 2 * length > least:  # whoever stood alone so far shares fewer words than needed
            kept = live
        follow = np.zeros(len(live), dtype=np.int64)
        inside = live + length < last[live]
        follow[inside] = rank[live[inside] + length] + 1
        key = rank[live] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        old = rank[live]
        at = np.arange(len(live))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))
        rank[live] = old + head - group
        length *= 2
        levels.append(rank.astype(levels[0].dtype))
        live = live[_shared(head)]
    if kept is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    suffixes = kept[np.argsort(rank[kept], kind="stable")]
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    lcp = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        for x in (a, b, lcp):
            x[ok] += 1 << k
    return suffixes, np.append(0, lcp)


def _shared(head: np.ndarray) -> np.ndarray:
    """Which places of an ordered list of group numbers are in a group of two or more."""
    edge = np.append(True, head[1:] != head[:-1]) if len(head) else np.zeros(0, dtype=bool)
    return ~(edge & np.append(edge[1:], True)) if len(head) else edge


def runs(word: np.ndarray, last: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of max(least, exponent * period) words or more, in no order."""
    floor = min(max((exponent - 1) * d, least - d, 1) for d in range(1, least + 1))
    suffixes, lcp = _sorted_suffixes(word, last, floor)
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    at, w, root = suffixes.tolist(), word, list(range(len(suffixes)))
    classes: dict[int, Positions] = {}
    found: list[tuple[int, int, int]] = []

    def seed(i: int, j: int, v: int) -> None:
        d = j - i
        if d * (exponent - 1) <= v and d + v >= least and (i == 0 or w[i - 1] != w[j - 1]):
            found.append((i, d + v, d))

    for e, v in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        x, y = e - 1, e
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        a, b = classes.get(x), classes.get(y)
        if (1 if a is None else a.size) < (1 if b is None else b.size):
            x, y, a, b = y, x, b, a
        root[y] = x
        if a is None:
            i, j = at[x], at[y]
            classes[x] = Positions(i, j)
            seed(min(i, j), max(i, j), v)
        elif b is None:
            i, j, k = at[y], *a.add(at[y])
            if j >= 0:
                seed(j, i, v)
            if k >= 0:
                seed(i, k, v)
        else:
            del classes[y]
            prev = after = -1
            for i in b:  # neighbours that come from the same class were neighbours before
                before, behind = a.add(i)
                if before != prev:
                    if after >= 0:
                        seed(prev, after, v)
                    if before >= 0:
                        seed(before, i, v)
                prev, after = i, behind
            if after >= 0:
                seed(prev, after, v)
    return found


def _collapse(data: np.ndarray, offsets: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[str]]:
    """The word count, the runs by start and period, and the kept words of each text."""
    w = words.split(data, offsets, False)
    n = np.diff(w.bound)
    text = np.repeat(np.arange(len(n)), n)
    keys, place = words.numbered(w.digests())
    last = np.repeat(w.bound[1:], n)
    every: list[list[tuple[int, int, int]]] = [[] for _ in n]
    gone = np.zeros(len(text) + 1, dtype=np.int64)
    for start, length, period in runs(text * len(keys) + place, last, least, exponent):
        t = int(text[start])
        every[t].append((start - int(w.bound[t]), length, period))
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    raw, kept = data.tobytes(), []
    for t, (a, z) in enumerate(zip(w.bound.tolist(), w.bound[1:].tolist(), strict=False)):
        own = raw[offsets[t] : offsets[t + 1]].split()
        if every[t]:
            every[t].sort(key=lambda r: (r[0], r[2]))
            own = compress(own, keep[a:z].tolist())
        kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    return n, every, kept


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_words, runs (start, length, period; by start, then period) and kept_text, a row for each row of docs.

    Words are runs of characters other than space and 0x09-0x0D, numbered from 0. A run is a longest stretch of words with
    smallest period q (words q apart are equal) of max(least, exponent * q) words or more. Words after the first q of a run
    are dropped; the kept ones are joined by one space.

    Texts are searched whole, each by itself, in one map without an exchange; memory grows with the longest text. A null text
    has no words, no runs and an empty kept text. Repeated rows come out each; nulls in other columns pass through; an empty
    table gives no rows. Words are equal if 128 bits of hash are. Columns that are not carried are not read; a carried column
    must not have a name given above.
    """
    rows = docs.select("doc_id", *carry, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offsets in words.texts(b.columns[-1]):
                n, every, kept = _collapse(data, offsets, least, exponent)
                flat = np.array([r for own in every for r in own], dtype=np.int64).reshape(-1, 3)
                bound = np.cumsum([0, *map(len, every)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(bound), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), pa.array(n, pa.int64()), found, pa.array(kept, pa.string())], [*b.schema.names[:-1], "n_words", "runs", "kept_text"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)), "n_words long", _RUN, "kept_text string"]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document in ten turns periodic from some word on, as a hash of its doc_id says.

    h = crc32 of the decimal doc_id, g = h div 10, n words. If h % 10 = 0 and n > 0, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    own = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")

    def planted(w):  # noqa: ANN001, ANN202
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        every = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int")))
        return F.when(n > 0, F.array_join(every, " "))

    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(F.get(F.transform(F.array(own), planted), F.lit(0)), "text")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The report of periodic_runs: the run of greatest length / period (ties: smallest start, then period) and hashes of runs and kept words.

    Lengths and periods are compared as exact fractions. A text without runs has four nulls.
    """
    text = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    better = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(better(b, r), r).otherwise(b))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
