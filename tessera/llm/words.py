"""Words of many texts at once, on NumPy arrays over Arrow's buffers.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text. Words of one text never
join with the next text's. All functions work on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
U64 = np.uint64
#: Any two odd numbers with well mixed bits; masks of the lowest bytes of eight.
ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit numbers with well mixed bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """The words of some texts: data[start[i]:end[i]] is word i; text t has the words bound[t] to bound[t + 1] - 1."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bound: np.ndarray

    def digests(self) -> np.ndarray:
        """128 bits of hash of each word in two columns: its length, then eight bytes at a time, mixed one after the other."""
        length = (self.end - self.start).astype(U64)
        out = np.stack([mix(length * ODD[0] + ODD[1]), mix(length * ODD[1] + ODD[0])], axis=1)
        if not len(length):
            return out
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        left, done = np.arange(len(length)), 0
        while len(left):
            chunk = eight[self.start[left] + done] & _LOW[np.minimum(length[left] - U64(done), U64(8)).astype(np.int64)]
            out[left, 0] = mix((out[left, 0] ^ chunk) * ODD[0])
            out[left, 1] = mix((out[left, 1] + chunk) * ODD[1])
            done += 8
            left = left[length[left] > U64(done)]
        return out

    def hashes(self) -> np.ndarray:
        """64 bits of hash of each word."""
        return self.digests()[:, 0]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by a sort: for millions of them that is faster than NumPy's hash table."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values in ascending order, the place of each value among them): Arrow's hash table finds them, only they are sorted."""
    coded = pa.array(np.ascontiguousarray(values)).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    turn = np.empty(len(order), dtype=np.int64)
    turn[order] = np.arange(len(order))
    return found[order], turn[coded.indices.to_numpy()]


def numbered(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct digests in ascending order, the place of each row among them)."""
    lead, place = places(digests[:, 0])
    second = np.zeros(len(lead), dtype=U64)
    second[place] = digests[:, 1]
    if (second[place] == digests[:, 1]).all():
        return np.stack([lead, second], axis=1), place
    order = np.lexsort([digests[:, 1], digests[:, 0]])
    by = digests[order]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (by[1:] != by[:-1]).any(axis=1)
    place[order] = np.cumsum(new) - 1
    return by[new], place


def texts(col: pa.Array | pa.ChunkedArray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about that many bytes at most; a null is an empty text."""
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    row = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk, "").cast(pa.large_string())
        n = len(chunk)
        if not n:
            continue
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + n + 1]
        held = chunk.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, n)
            yield row + at, row + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        row += n


def split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """The words of texts given as bytes and offsets; `lower` turns A-Z into a-z first."""
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    first = edge[edge < len(data)]
    opens[first] = inside[first]
    last = edge[edge > 0] - 1
    closes[last] = inside[last]
    start = np.flatnonzero(opens)
    return Words(data, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    out = np.zeros(len(bound) - 1, dtype=np.float64)
    full = bound[1:] > bound[:-1]
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), bound[:-1][full])
    return out
