"""Elias-Fano sequences and an n-gram trie of them, in memory-mapped arrays, searched many keys at a time."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U64 = np.uint64


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The same arrays over one memory-mapped file, which has no name and so goes with the process."""
    with tempfile.TemporaryFile() as f:
        at = []
        for a in arrays:
            f.write(bytes(-f.tell() % 8))
            at.append(f.tell())
            f.write(np.ascontiguousarray(a).tobytes())
        f.write(bytes(16))
        f.flush()
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(view, a.dtype, a.size, k) for a, k in zip(arrays, at, strict=True)]


_EACH = U64(0x0101010101010101)
#: The place of set bit number k of a byte.
_PLACE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.int64)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of set bit number k of each 64-bit word."""
    count = word - ((word >> U64(1)) & U64(0x5555555555555555))
    count = (count & U64(0x3333333333333333)) + ((count >> U64(2)) & U64(0x3333333333333333))
    sums = ((count + (count >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte j: the set bits of bytes 0 to j
    k = k.astype(U64)
    top = _EACH << U64(7)
    at = U64(8) * np.minimum(np.bitwise_count((((k * _EACH) | top) - sums) & top), 7).astype(U64)  # a top bit stays where a sum is k at most
    rest = k - (((sums << U64(8)) >> at) & U64(255))
    return at.astype(np.int64) + _PLACE[((word >> at) & U64(255)).astype(np.int64), rest.astype(np.int64)]


class EliasFano:
    """Ascending 64-bit numbers: low bits packed, high bits as gaps in unary, with counts of zeros and ones for each 64 bits."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        n = self.n = len(values)
        self.bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        b = U64(self.bits)
        high = (values >> b).astype(np.int64)
        self.buckets = (top >> self.bits) + 1
        marks = np.zeros(-(-(n + self.buckets) // 64) * 64, dtype=np.uint8)
        marks[high + np.arange(n)] = 1
        upper = np.packbits(marks, bitorder="little").view("<u8")
        low = (values & U64((1 << self.bits) - 1)).astype("<u8")
        bits = np.unpackbits(low.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, : self.bits]
        lower = np.concatenate([np.packbits(bits.reshape(-1), bitorder="little"), np.zeros(16, np.uint8)])
        ones = np.cumsum(np.bitwise_count(upper).astype(np.int64))
        zeros = 64 * np.arange(1, len(upper) + 1) - ones
        self.upper, self.lower, self.zeros, self.ones = mapped([upper, lower, zeros, ones])
        self.words = np.ndarray(len(self.lower) - 8, dtype="<u8", buffer=self.lower, strides=(1,))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of zero number k."""
        w = np.searchsorted(self.zeros, k, "right")
        before = np.where(w > 0, self.zeros[w - 1], 0)
        return 64 * w + _select(~self.upper[w], k - before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return (self.words[at >> 3] >> (at & 7).astype(U64)) & U64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Value number i: its bucket is the number of zeros before one number i."""
        w = np.searchsorted(self.ones, i, "right")
        before = np.where(w > 0, self.ones[w - 1], 0)
        high = 64 * w + _select(self.upper[w], i - before) - i
        return (high.astype(U64) << U64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= x among those with x's high bits, or where they end; whether that value is x)."""
        if not self.n or not len(x):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        high = (x >> U64(self.bits)).astype(np.int64)
        inside = high < self.buckets
        high = np.minimum(high, self.buckets - 1)
        lo = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1 - high, 0)
        end = self._zero(high) - high
        hi = end.copy()
        low = x & U64((1 << self.bits) - 1)
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            less = self._low(mid) < low[left]
            lo[left] = np.where(less, mid + 1, lo[left])
            hi[left] = np.where(less, hi[left], mid)
            left = left[lo[left] < hi[left]]
        return lo, inside & (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == low)


#: log10 of a quantised number goes from -FLOOR to 0 in LEVELS steps.
FLOOR, LEVELS = 16.0, 65535


def quantised(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 in 16 bits; 0 stays 0."""
    code = np.rint((np.log10(np.clip(x, 10.0**-FLOOR, 1.0)) + FLOOR) / FLOOR * (LEVELS - 1)) + 1
    return np.where(x > 0, code, 0).astype("<u2")


def value(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(np.float64) - 1) / (LEVELS - 1) * FLOOR - FLOOR), 0.0)


class Level:
    """A level of a trie: contexts, pointers to the range of their followers, followers relative to their context, codes.

    Followers ascend within a context, so they ascend over all contexts once the context's rank stands in front.
    """

    def __init__(self, contexts: np.ndarray, followers: np.ndarray, rank: np.ndarray, codes: np.ndarray) -> None:
        """contexts: ascending; followers: by context, ascending; rank: the place of each follower's context; its code."""
        n = len(contexts)
        self.bits = 64 if n <= 1 else int(followers.max()).bit_length() if len(followers) else 1
        self.contexts = EliasFano(contexts, int(contexts[-1]) if n else 1)
        self.pointers = EliasFano(np.searchsorted(rank, np.arange(n + 1)).astype(U64), max(1, len(followers)))
        self.followers = EliasFano(self._keys(rank, followers), int(self._keys(rank[-1:], followers[-1:])[0]) if len(followers) else 1)
        (self.codes,) = mapped([codes])

    def _keys(self, rank: np.ndarray, followers: np.ndarray) -> np.ndarray:
        return followers if self.bits == 64 else (rank.astype(U64) << U64(self.bits)) | followers

    def search(self, contexts: np.ndarray, followers: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For follower i of contexts[which[i]]: its place or where it would be, and whether it is there.

        which counts for more than one context; a level of one context takes all followers to be its own.
        """
        rank, known = self.contexts.successor(contexts)
        begin = np.zeros(len(contexts), dtype=np.int64)
        close = begin.copy()
        if known.any():
            begin[known] = self.pointers.access(rank[known]).astype(np.int64)
            close[known] = self.pointers.access(rank[known] + 1).astype(np.int64)
        if self.bits == 64:
            at, found = self.followers.successor(followers)
            return at, found
        own = which
        fits = (followers >> U64(self.bits)) == 0
        at, found = self.followers.successor(self._keys(rank[own], np.where(fits, followers, U64((1 << self.bits) - 1))))
        return at, found & fits & known[own] & (at >= begin[own]) & (at < close[own])
