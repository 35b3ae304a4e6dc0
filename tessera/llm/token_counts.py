"""Token counts of whole texts by the whole-token shortcut.

The vocabulary says, once and offline, which pre-tokens end up as one token: its entries with a word end whose own merges
give that entry back. Such a pre-token counts one wherever it stands. Only the others are merged, each distinct one once
for as long as its worker remembers it. Pieces between white space are counted by themselves: neither the normaliser nor
the pre-tokenizer's pattern reaches over white space.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces in each of the two generations that a worker remembers (and merged pre-tokens in one), and the
#: characters of the longest remembered one: the bounds of memory, about 100 MB. Bytes of a word up to which the least pair
#: is searched for instead of kept in a heap.
KEPT, PIECE, SHORT = 200_000, 64, 40
#: Characters that Python splits at, unlike the tokenizer.
_CONTROL = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\s+")


@lru_cache(2)
def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 is itself, the rest follows 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class Merges:
    """The merge table of a byte-level BPE vocabulary with word ends, over token ids."""

    def __init__(self, path: str) -> None:
        model = _spec(path)["model"]
        self.ends = model["end_of_word_suffix"] or ""
        self.id = model["vocab"]
        #: A pair's rank under both ids in one number, and the token that each rank makes.
        self.rank = {self.id[a] << 32 | self.id[b]: k for k, (a, b) in enumerate(model["merges"])}
        self.made = [self.id[a + b] for a, b in model["merges"]]
        self.sign = _byte_signs()
        self.inner = [self.id[self.sign[b]] for b in range(256)]
        self.last = [self.id[self.sign[b] + self.ends] for b in range(256)]

    def merged(self, word: str) -> list[int]:
        """The tokens of one pre-token: the pair of least rank merges, of equal ones the leftmost, until none is left."""
        raw = word.encode("utf-8")
        s = [self.inner[b] for b in raw]
        s[-1] = self.last[raw[-1]]
        if len(s) > SHORT:
            return self._by_heap(s)
        rank, made, none = self.rank.get, self.made, len(self.made)
        found = [rank(a << 32 | b, none) for a, b in zip(s, s[1:], strict=False)]
        while found and (least := min(found)) < none:
            k = found.index(least)
            s[k] = made[least]
            del s[k + 1], found[k]
            if k < len(found):
                found[k] = rank(s[k] << 32 | s[k + 1], none)
            if k:
                found[k - 1] = rank(s[k - 1] << 32 | s[k], none)
        return s

    def _by_heap(self, s: list[int]) -> list[int]:
        """The same in n log n steps: places are linked to both sides, and an entry of the heap counts only if its pair still stands there."""
        rank, n = self.rank, len(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[x], k, x) for k, x in enumerate(a << 32 | b for a, b in zip(s, s[1:], strict=False)) if x in rank]
        heapq.heapify(heap)
        while heap:
            least, k, x = heapq.heappop(heap)
            j = right[k]
            if s[k] < 0 or j >= n or s[k] << 32 | s[j] != x:
                continue
            s[k], s[j], right[k] = self.made[least], -1, right[j]
            if right[j] < n:
                left[right[j]] = k
            for at in (left[k], k):
                if at >= 0 and right[at] < n and (x := s[at] << 32 | s[right[at]]) in rank:
                    heapq.heappush(heap, (rank[x], at, x))
        return [x for x in s if x >= 0]


@lru_cache(2)
def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that are proved to be one token: vocabulary entries that their own merges give back."""
    merges = Merges(path)
    of = {c: b for b, c in merges.sign.items()}
    out = set()
    for entry, number in merges.id.items():
        inner = entry.removesuffix(merges.ends) if entry.endswith(merges.ends) else ""
        if not inner or any(c not in of for c in inner):
            continue
        try:
            word = bytes(of[c] for c in inner).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if merges.merged(word) == [number]:
            out.add(word)
    return frozenset(out)


class Counter(dict):
    """The number of tokens of each piece of text between white space; a piece met for the first time is counted then."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        super().__init__()
        spec = _spec(path)
        library = tokenizers.Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        special = [t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.marks = sorted({x[0] for x in special})
        self.classes = [regex.compile(c).fullmatch for c in (r"\s", r"\p{L}", r"\p{N}")]
        self.merges, self.whole = Merges(path), whole
        self.same: dict[str, bool] = {}
        self.older: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def _agrees(self, c: str) -> bool:
        """Whether the library puts a character into the class that this process' regular expressions put it into. They differ on characters newer than one of both."""
        if c not in self.same:
            own = next((k for k, f in enumerate(self.classes) if f(c)), 3)
            twice, after = len(self.cut(c + c)), len(self.cut("a" + c))
            theirs = 0 if not twice else 2 if twice == 2 else 1 if after == 1 else 3
            self.same[c] = own == theirs
        return self.same[c]

    def _segment(self, text: str) -> int:
        if text.isascii():
            words = self.words(text.lower())
        else:
            text = self.normalize(text)
            if all(map(self._agrees, set(text))):
                words = self.words(text)
            else:
                back = {s: b for b, s in self.merges.sign.items()}
                words = [bytes(back[c] for c in w).decode("utf-8") for w, _ in self.cut(text)]
        n = 0
        for w in words:
            n += 1 if w in self.whole else self.merged.get(w) or self._merge(w)
        return n

    def _merge(self, word: str) -> int:
        n = len(self.merges.merged(word))
        if len(word) <= PIECE:
            if len(self.merged) >= KEPT:
                self.merged.clear()
            self.merged[word] = n
        return n

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            if any(m in piece for m in self.marks):
                n = len(self.special.findall(piece)) + sum(self._segment(s) for s in self.special.split(piece) if s)
            else:
                n = self._segment(piece)
        if len(piece) <= PIECE:
            if len(self) >= KEPT:  # what is in use moves on to the next generation, the rest goes
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        pieces = _WHITE.split(text) if _CONTROL.search(text) else text.split()
        return sum(map(self.__getitem__, pieces))


@lru_cache(1)
def _counter(path: str, whole: frozenset[str]) -> Counter:
    """The counter of a worker, which later tasks of the worker take over with what it remembers."""
    return Counter(path, whole)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each row of docs.

    Counts are those of the tokenizers library for the file at path (byte-level BPE with word ends) without begin, end or
    padding; special strings inside a text are one token each, as the library's default is. The file must be on every
    executor; the table of whole tokens goes to them with the task (the size of the vocabulary bounds it).

    Every whole text is counted; one map over the rows, no exchange. A null text is empty: 0 bytes, 0 tokens, not over the
    limit. Repeated rows come out each; nulls in other columns pass through; an empty table gives no rows. Columns that are
    not carried are not read; a carried column must not have a name given above.
    """
    rows = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text"))
    whole = whole_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, whole)
        for b in batches:
            text = b.columns[-1]
            n = pa.array([counter.count(x.as_py()) for x in text], pa.int64())
            size = pa.compute.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, n, pa.compute.greater(n, limit)], [*b.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)), "n_bytes long", "n_tokens long", "over_limit boolean"]))
