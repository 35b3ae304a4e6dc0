"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is cut into pieces (a run of white space, then a run of other characters); the tokenizer's pattern never matches
over the edge of a piece, and it cuts each piece into words. A word that is in the vocabulary is its token, as in tiktoken.
For the others, rows of (word, position, token) join the merge table; each
round contracts every word's leftmost pair of least rank, until no pair is left: the pair's second row takes the merged
token, the row before points to it, so no row is numbered anew. An ordered aggregation of the tokens'
bytes decodes. A partition does this for its distinct words only, in bounded portions; distinct pieces are then put together from
the distinct words, and texts from the pieces, by Arrow's take.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import scratch
from tessera.llm import words as split

#: The characters with the Unicode property White_Space: what \\s means to the tokenizer; those beyond ASCII as UTF-8.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Words in one recursive query and the sum of their squared lengths (twice the rows of all rounds), bytes of text in one
#: portion, words in each of the two generations that a task keeps between portions: the bounds of memory.
WORDS, SQUARES, PORTION, KEPT = 20_000, 3_000_000, 1 << 21, 60_000
#: Sequences that one query decodes.
DECODED = 400
#: A longer word takes as many rounds as it has bytes, so the same contraction is done with a heap.
LONG = 1000

_ENCODE = """
WITH RECURSIVE step(n, w, pos, id, npos, nid) AS (
  SELECT 0, w, pos, id, npos, nid FROM start
  UNION ALL
  (WITH best AS (
     SELECT w, min((CAST(rank AS BIGINT) << 20) | (CAST(pos AS BIGINT) << 10) | npos) AS k FROM step JOIN merges ON id = l AND nid = r GROUP BY w
   ), pair AS (
     SELECT w, CAST(k >> 20 AS INT) AS rank, CAST((k >> 10) & 1023 AS INT) AS head, CAST(k & 1023 AS INT) AS tail FROM best
   )
   SELECT n + 1, s.w, pos, CASE WHEN pos = tail THEN rank ELSE id END, CASE WHEN npos = head THEN tail ELSE npos END, CASE WHEN npos = head THEN rank ELSE nid END
   FROM step AS s JOIN pair USING (w) WHERE pos <> head)
)
SELECT w, pos, id FROM step JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) AS last USING (w, n)
"""
_DECODE = "SELECT w, string_agg(s, '' ORDER BY pos) AS s FROM {tokens} JOIN vocabulary USING (id) GROUP BY w ORDER BY w"
#: All words end to end: one sort, where a group for each word takes a sort for each.
_DECODE_ALL = "SELECT string_agg(s, '' ORDER BY w, pos) FROM encoded JOIN vocabulary USING (id)"


@lru_cache(2)
def _tables(rank_file: str) -> tuple[pa.Table, pa.Table]:
    """(merges, vocabulary) of the rank file: a few megabytes that a worker keeps."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    splits = np.array([(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks], dtype=np.int32)
    merges = pa.table({n: pa.array(np.ascontiguousarray(splits[:, k])) for k, n in enumerate(("l", "r", "rank"))})
    return merges, pa.table({"id": pa.array(ranks.values(), pa.int32()), "s": pa.array([t.decode("latin-1") for t in ranks])})


class Tokenizer:
    """The merges and the vocabulary in a DuckDB database, for one task: it is closed, and what it kept let go, with the task."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        import duckdb
        import regex

        self.merges, vocabulary = _tables(rank_file)
        self.token = {i: t.encode("latin-1") for i, t in zip(vocabulary["id"].to_pylist(), vocabulary["s"].to_pylist(), strict=True)}
        self.whole = {t: (i.to_bytes(4, "little"), t) for i, t in self.token.items()}
        self.size = np.zeros(max(self.token) + 1, dtype=np.int64)
        self.size[list(self.token)] = [len(t) for t in self.token.values()]
        self.byte = np.array([int.from_bytes(self.whole[bytes([b])][0], "little") for b in range(256)], dtype=np.int32)
        own = pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]")
        self.words = regex.compile(own).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        for name, table in (("merges", self.merges), ("vocabulary", vocabulary)):
            self.db.register(f"given_{name}", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given_{name}")
            self.db.unregister(f"given_{name}")
        self.pair: dict[tuple[int, int], int] = {}
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}

    def __enter__(self) -> Tokenizer:
        return self

    def __exit__(self, *_: object) -> None:
        self.db.close()
        self.pair, self.known, self.older, self.whole = {}, {}, {}, {}
        gc.collect()
        scratch.release()

    def _long(self, word: bytes) -> list[int]:
        if not self.pair:
            self.pair = {(a, b): i for a, b, i in zip(*(self.merges[c].to_pylist() for c in ("l", "r", "rank")), strict=True)}
        ids = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.pair[x], k, x) for k, x in enumerate(zip(ids, ids[1:], strict=False)) if x in self.pair]
        heapq.heapify(heap)
        while heap:
            rank, k, x = heapq.heappop(heap)
            b = after[k]
            if ids[k] < 0 or b >= len(ids) or (ids[k], ids[b]) != x:
                continue
            ids[k], ids[b], after[k] = rank, -1, after[b]
            if after[k] < len(ids):
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < len(ids) and (y := (ids[a], ids[after[a]])) in self.pair:
                    heapq.heappush(heap, (self.pair[y], a, y))
        return [i for i in ids if i >= 0]

    def _encoded(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """The ids and the decoded ids of each word."""
        out = {w: (b"".join(i.to_bytes(4, "little") for i in ids), b"".join(self.token[i] for i in ids)) for w in words if len(w) > LONG for ids in [self._long(w)]}
        for part in _groups([w for w in words if len(w) <= LONG]):
            n = np.array([len(w) for w in part])
            first = np.cumsum(n) - n
            ids = self.byte[np.frombuffer(b"".join(part), dtype=np.uint8)]
            after = np.append(ids[1:], -1).astype(np.int32)
            after[first + n - 1] = -1
            pos = (np.arange(n.sum()) - np.repeat(first, n)).astype(np.int32)
            start = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": pos, "id": ids, "npos": pos + np.int32(1), "nid": after})
            self.db.register("start", start)
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE encoded AS {_ENCODE}")
            ids = self.db.execute("SELECT w, id FROM encoded ORDER BY w, pos").fetchnumpy()
            text = self.db.execute(_DECODE_ALL).fetchall()[0][0].encode("latin-1")
            self.db.unregister("start")
            at = np.searchsorted(ids["w"], np.arange(len(part) + 1))
            ends = np.concatenate([[0], np.cumsum(self.size[ids["id"]])])[at].tolist()
            cuts = (4 * at).tolist()
            raw = np.ascontiguousarray(ids["id"], dtype="<u4").tobytes()
            out |= {w: (raw[a:b], text[c:d]) for w, a, b, c, d in zip(part, cuts, cuts[1:], ends, ends[1:], strict=False)}
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
        """(the first piece of each text, and the end; all pieces; whether each is white space and then other characters)."""
        white = split.SPACE[data]
        for c in _WIDE if data.max(initial=0) > 127 else ():
            at = np.flatnonzero(data[: len(data) - len(c) + 1] == c[0]) if len(data) >= len(c) else np.zeros(0, dtype=np.int64)
            for k in range(1, len(c)):
                at = at[data[at + k] == c[k]]
            for k in range(len(c)):
                white[at + k] = True
        opens = white.copy()
        opens[1:] &= ~white[:-1]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(opens)
        cuts = np.append(start, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        return np.searchsorted(start, offsets), pieces, white[start] & ~white[cuts[1:] - 1]

    def _words(self, pieces: pa.LargeBinaryArray, full: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(the words of all pieces, the full ones first; the first word of each piece in this order, and the end; the place of each piece in it).

        full: white space, then other characters. Such pieces end to end have the words that each has alone, so they are cut at once.
        """
        order = np.argsort(~full, kind="stable")
        count = int(full.sum())
        parts = pieces.take(pa.array(order))
        offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64)[: len(parts) + 1]
        text = parts.buffers()[2].to_pybytes()[: offsets[count]].decode("utf-8") if count else ""
        rest = [self.words(p.decode("utf-8")) for p in parts.slice(count).to_pylist()]
        words = self.words(text)
        ahead = len(words)
        words += [w for own in rest for w in own]
        found = pa.array(words, pa.large_string()).cast(pa.large_binary())
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[: ahead + 1] if len(found) else np.zeros(1, dtype=np.int64)
        if ends[-1] != offsets[count]:  # the pattern leaves characters out, so lengths don't tell whose a word is
            return self._words(pieces, np.zeros(len(full), dtype=bool))
        bound = np.searchsorted(ends, offsets[: count + 1])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return found, np.concatenate([bound, ahead + np.cumsum([len(own) for own in rest], dtype=np.int64)]), place

    def _each(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids and the decoded ids of distinct words."""
        if len(self.known) > KEPT:  # what is in use moves on to the next generation, the rest goes
            self.older, self.known = self.known, {}
        whole, known, older = self.whole, self.known, self.older
        other = [w for w in words if w not in whole]
        new = [w for w in other if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        known.update(self._encoded(sorted((w for w in new if w not in older), key=len)))  # short words need few rounds
        return [whole.get(w) or known[w] for w in words]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
        """(first row, end row, ids as little-endian unsigned 32-bit numbers, the bytes that they decode to) of some texts at a time."""
        for a, z, data, offsets in split.texts(column, PORTION):
            bound, pieces, full = self._pieces(data, offsets)
            coded = pieces.dictionary_encode()
            piece = coded.indices.to_numpy()
            kind = np.zeros(len(coded.dictionary), dtype=bool)
            kind[piece] = full
            words, first, place = self._words(coded.dictionary, kind)
            own = words.dictionary_encode()
            found = self._each(own.dictionary.to_pylist())
            turn = pa.array(place[piece])
            yield a, z, *(_joined(_joined(pa.array([x[k] for x in found], pa.large_binary()).take(own.indices), first).take(turn), bound).cast(pa.binary()) for k in (0, 1))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids, by one ordered aggregation."""
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        tokens = pa.table({"w": np.repeat(np.arange(len(ids), dtype=np.int32), n), "pos": np.arange(n.sum()), "id": np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)})
        self.db.register("tokens", tokens)
        found = dict(self.db.execute(_DECODE.format(tokens="tokens")).fetchall())
        self.db.unregister("tokens")
        return [found.get(k, "").encode("latin-1") for k in range(len(ids))]


def _groups(words: list[bytes]) -> Iterator[list[bytes]]:
    at, rows = 0, 0
    for k, w in enumerate(words):
        rows += len(w) ** 2
        if rows >= SQUARES or k + 1 - at >= WORDS:
            yield words[at : k + 1]
            at, rows = k + 1, 0
    if at < len(words):
        yield words[at:]


def _joined(parts: pa.LargeBinaryArray, bound: np.ndarray) -> pa.Array:
    """One value for each range of parts, end to end."""
    offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64)[parts.offset : parts.offset + len(parts) + 1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bound) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[bound])), parts.buffers()[2]])


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, ids (little-endian unsigned 32-bit, no special tokens) and decoded (their bytes).

    rank_file and pattern are those of a tiktoken vocabulary; the file must be on every executor. Each whole text is
    encoded. A null or an empty text has no ids. Repeated rows come out each; an empty table gives no rows; nulls in other
    columns pass through. Columns that are not carried are not read; a carried column must not be named ids or decoded.
    """
    rows = docs.select("doc_id", *carry, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Tokenizer(rank_file, pattern) as tok:
            for b in batches:
                for a, z, ids, decoded in tok.encode(b.column("text")):
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), ids, decoded], [*b.schema.names[:-1], "ids", "decoded"])
                scratch.release()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)), "ids binary", "decoded binary"]))


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns and decoded: the bytes of the ids column, as bpe_encode writes it. Null ids decode to nothing."""
    rows = encoded.select("doc_id", *carry, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Tokenizer(rank_file, pattern) as tok:
            for b in batches:
                for a in range(0, b.num_rows, DECODED):
                    own = b.slice(a, DECODED)
                    found = tok.decode([x or b"" for x in own.column("ids").to_pylist()])
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(found, pa.binary())], [*b.schema.names[:-1], "decoded"])

    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)), "decoded binary"]))
