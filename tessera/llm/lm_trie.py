"""A smoothed trigram model of the corpus in Elias-Fano tries, and the log probability of every text under it.

Batches of documents ask shards of the trie (tessera.llm.batches), one level after the other: words, bigrams, trigrams. A
shard merges what all batches counted, builds its part of the level and answers by successor searches in it: the count, the
quantised probability, and a number by which the next level refers to the node. Words are told apart by 128 bits of hash and
numbered from the most frequent on, so followers of a context are small numbers. A context that holds more than a shard's
share of the corpus is dealt to several shards by its followers.

P1(w) = (count(w) - DISCOUNT) / N, or DISCOUNT * V / N for the unknown word. A longer context c of count k has
P(w | c) = count(c w) / (k + m) + m / (k + m) * P(w | c without its first word) with m = MASS * sqrt(k + 1). All sum to one. The
first terms, and count(w) - DISCOUNT, are what the levels keep, quantised.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import batches, words
from tessera.llm.elias_fano import Level, quantised, value

U64 = np.uint64
#: The weight of the shorter context for contexts of one and two words, and the discount of a word's count.
MASS, DISCOUNT = (20.0, 1.0), 0.75
#: The largest count minus the discount that level one can tell from larger ones.
TOP = 1e12
#: What stands for the end of a text: the digest of a word without bytes, which no text has.
END = words.Words(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)).digests()[0]


def _held_out(ids: list, divisor: int = 7, which: int = 2) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % divisor == which for i in ids], dtype=bool)


@dataclass
class Batch:
    """tokens: the words of all texts, each text followed by its end, as places in `key` (ascending 128-bit hashes)."""

    tokens: np.ndarray
    bound: np.ndarray
    key: np.ndarray
    trains: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Batch:
        parts, counts = [np.zeros((0, 2), dtype=U64)], [np.zeros(0, dtype=np.int64)]
        for _, _, data, offsets in words.texts(rows.column("text")):
            w = words.split(data, offsets, lower=True)
            parts.append(np.insert(w.digests(), w.bound[1:], END, axis=0))
            counts.append(np.diff(w.bound) + 1)
        bound = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        key, tokens = words.numbered(np.concatenate(parts))  # the same key in each pass, whatever the order of the rows
        trains = np.repeat(~_held_out(rows.column("doc_id").to_pylist()), np.diff(bound))
        return cls(tokens, bound, key, trains)


def _word_cuts(batch: Batch, shards: int) -> list[int]:
    return [*np.searchsorted(batch.key[:, 0], np.array([(k << 64) // shards for k in range(shards)], dtype=U64)).tolist(), len(batch.key)]


def _ask_words(batch: Batch, shards: int) -> list[tuple[int, bytes]]:
    count = np.bincount(batch.tokens[batch.trains], minlength=len(batch.key)).astype("<u4")
    cuts = _word_cuts(batch, shards)
    out = []
    for s, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):  # an empty question too: each answer holds its shard's part of N and V
        out.append((s, batches.join([batches.pack_sorted(batch.key[a:z, 0]), batches.pack(batch.key[a:z, 1]), batches.pack(count[a:z])])))
    return out


def _answer_words(shard: int, asked: dict[int, bytes], shards: int) -> dict[int, bytes]:
    given = {g: batches.parts(b) for g, b in asked.items()}
    key, place = words.numbered(np.stack([np.concatenate([batches.unpack_sorted(p[0]) for p in given.values()]), np.concatenate([batches.unpack(p[1], "<u8") for p in given.values()])], axis=1))
    count = np.bincount(place, np.concatenate([batches.unpack(p[2], "<u4") for p in given.values()]).astype(np.float64), minlength=len(key)).astype("<i8")
    rank = np.empty(len(count), dtype="<i8")
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    # the first level: its one context is the empty one, whose followers are the hashes of the words
    lead = key[:, 0]
    level = Level(np.zeros(1, dtype=U64), lead, np.zeros(len(lead), dtype=np.int64), quantised(np.maximum(count - DISCOUNT, 0) / TOP))
    at, _ = level.search(np.zeros(1, dtype=U64), lead, np.zeros(len(lead), dtype=np.int64))
    code = level.codes[at + np.arange(len(lead)) - np.searchsorted(lead, lead)]  # words with equal first halves stand one after the other
    node = (rank * shards + shard + 1).astype("<u8")  # 0 is the mark before a text
    head = np.array([count.sum(), (count > 0).sum()], dtype="<i8").tobytes()
    out, at = {}, 0
    for g, p in given.items():
        mine = place[at : at + len(batches.unpack(p[2], "<u4"))]
        at += len(mine)
        out[g] = batches.join([head, batches.pack(count[mine]), batches.pack(node[mine]), batches.pack(code[mine])])
    return out


class Known:
    """What the shards of words answered to a batch, and the tokens renumbered by node: 0 the mark before a text, then trained words in the order of their nodes, then others."""

    def __init__(self, batch: Batch, got: dict[int, bytes], shards: int) -> None:
        given = [batches.parts(got[s]) for s in range(shards)]
        heads = np.array([np.frombuffer(p[0], "<i8") for p in given])
        self.n, self.v = heads.sum(axis=0).tolist()
        count, node, code = (np.concatenate([batches.unpack(p[k], kind) for p in given]) for k, kind in ((1, "<i8"), (2, "<u8"), (3, "<u2")))
        order = np.lexsort([node, count == 0])
        turn = np.empty(len(order), dtype=np.int64)
        turn[order] = np.arange(1, len(order) + 1)
        self.count = np.concatenate([[0], count[order]])
        self.node = np.concatenate([np.zeros(1, dtype=U64), node[order]])
        alone = np.where(self.count[1:] > 0, value(code[order]) * TOP, DISCOUNT * self.v) / max(1, self.n)
        self.alone = np.concatenate([[1.0], alone if self.n else np.ones(len(order))])
        self.end = int(turn[np.flatnonzero((batch.key == END).all(axis=1))[0]])
        self.total = self.count.copy()
        self.total[0] = self.count[self.end]  # a text begins as often as one ends
        self.tokens = turn[batch.tokens]
        self.wide = len(self.count)


class Asked:
    """The distinct (context, token) of a batch: the training count of each, which are asked for, and where their answers are.

    context: a number for each token whose contexts `node` and `total` describe, in the order of their nodes; -1 for none.
    """

    def __init__(self, known: Known, batch: Batch, context: np.ndarray, node: np.ndarray, total: np.ndarray, shards: int) -> None:
        held = np.flatnonzero(context >= 0)
        pairs, back = np.unique(context[held] * known.wide + known.tokens[held], return_inverse=True)
        self.back = np.full(len(context), -1, dtype=np.int64)
        self.back[held] = back
        self.own, self.follower = np.divmod(pairs, known.wide)
        self.node, self.total = node, total
        self.count = np.bincount(back[batch.trains[held]], minlength=len(pairs))
        ask = np.flatnonzero((total[self.own] > 0) & (known.count[self.follower] > 0))
        ways = np.clip(total[self.own[ask]] * shards // max(1, known.n), 1, shards).astype(U64)
        word = known.node[self.follower[ask]]
        shard = (words.mix(node[self.own[ask]] * words.ODD[0] + words.mix(word) % ways) % U64(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
        turn = np.argsort(shard, kind="stable")
        self.order, self.word = ask[turn], word[turn]
        self.cuts = np.searchsorted(shard[turn], np.arange(shards + 1))

    def questions(self) -> list[tuple[int, bytes]]:
        out = []
        for s, (a, z) in enumerate(zip(self.cuts.tolist(), self.cuts[1:].tolist(), strict=False)):
            if a == z:
                continue
            mine, word = self.order[a:z], self.word[a:z]
            lead = np.flatnonzero(np.diff(self.own[mine], prepend=-1))
            rank = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, z - a))).astype(U64)
            bits = int(word.max()).bit_length()
            heads = self.own[mine[lead]]
            out.append((s, batches.join([bytes([bits]), batches.pack_sorted(self.node[heads]), batches.pack(self.total[heads].astype("<i8")), batches.pack_sorted((rank << U64(bits)) | word), batches.pack(self.count[mine].astype("<u4"))])))
        return out

    def answers(self, got: dict[int, bytes], level: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, probability, node) of each pair, zero where it was never trained."""
        count, part, node = np.zeros(len(self.own), dtype=np.int64), np.zeros(len(self.own)), np.zeros(len(self.own), dtype=U64)
        for s in np.flatnonzero(np.diff(self.cuts)).tolist():
            p = batches.parts(got[level * shards + s])
            mine = self.order[self.cuts[s] : self.cuts[s + 1]]
            part[mine] = value(batches.unpack(p[0], "<u2"))
            if len(p) > 1:
                count[mine] = batches.unpack(p[1], "<u4")
                node[mine] = batches.unpack_sorted(p[2]) * U64(shards) + U64(s + 1)
        return count, part, node


def _answer(asked: dict[int, bytes], mass: float, last: bool) -> dict[int, bytes]:
    """Build a shard's part of a level below the first, and search it for what is asked."""
    given = {}
    for g, b in asked.items():
        bits, heads, total, keys, count = batches.parts(b)
        given[g] = (bits[0], batches.unpack_sorted(heads), batches.unpack(total, "<i8"), batches.unpack_sorted(keys), batches.unpack(count, "<u4"))
    bits = max(p[0] for p in given.values())
    contexts, first = np.unique(np.concatenate([p[1] for p in given.values()]), return_index=True)
    total = np.concatenate([p[2] for p in given.values()])[first].astype(np.float64)
    keys = []
    for b, heads, _, own, _ in given.values():
        rank = np.searchsorted(contexts, heads).astype(U64)[(own >> U64(b)).astype(np.int64)]
        keys.append((rank << U64(bits)) | (own & U64((1 << b) - 1)))
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(place, np.concatenate([p[4] for p in given.values()]).astype(np.float64), minlength=len(keys))
    seen = count > 0
    rank = (keys >> U64(bits)).astype(np.int64)
    low = keys & U64((1 << bits) - 1)
    of = total[rank[seen]]
    level = Level(contexts, low[seen], rank[seen], quantised(count[seen] / (of + mass * np.sqrt(of + 1))))
    at, found = level.search(contexts, low, rank)
    code = np.where(found, level.codes[np.minimum(at, len(level.codes) - 1)], 0).astype("<u2") if len(level.codes) else np.zeros(len(keys), dtype="<u2")
    out, start = {}, 0
    for g, p in given.items():
        mine = place[start : start + len(p[3])]
        start += len(mine)
        own = [batches.pack(code[mine])]
        out[g] = batches.join(own if last else [*own, batches.pack(count[mine].astype("<u4")), batches.pack_sorted(at[mine].astype(U64))])
    return out


def _begin(batch: Batch, tokens: np.ndarray) -> np.ndarray:
    """The token before each one; 0, the mark before a text, for the first."""
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = tokens[:-1]
    before[batch.bound[:-1]] = 0
    return before


class Texts:
    """A batch with what it knows after the first, and then the second, level has answered."""

    def __init__(self, rows: pa.Table, got: dict[int, bytes], shards: int, mass: tuple[float, float]) -> None:
        self.batch, self.shards, self.mass = Batch.of(rows), shards, mass
        self.known = Known(self.batch, got, shards)
        self.two = Asked(self.known, self.batch, _begin(self.batch, self.known.tokens), self.known.node, self.known.total, shards)

    def extend(self, got: dict[int, bytes]) -> None:
        two, known = self.two, self.known
        count, part, node = two.answers(got, 1, self.shards)
        self.pair = part + self._rest(known.total[two.own], 0) * known.alone[two.follower]
        order = np.lexsort([node, count == 0])
        turn = np.empty(len(order), dtype=np.int64)
        turn[order] = np.arange(len(order))
        before = np.full(len(known.tokens), -1, dtype=np.int64)
        before[1:] = turn[two.back[:-1]]
        before[self.batch.bound[:-1]] = -1
        self.left = count[order]
        self.three = Asked(known, self.batch, before, node[order], self.left, self.shards)

    def _rest(self, total: np.ndarray, k: int) -> np.ndarray:
        m = self.mass[k] * np.sqrt(total + 1)
        return m / (total + m)

    def score(self, got: dict[int, bytes]) -> dict[str, np.ndarray]:
        known, bound, three = self.known, self.batch.bound, self.three
        _, part, _ = three.answers(got, 2, self.shards)
        each = self.pair[self.two.back]
        longer = np.flatnonzero(three.back >= 0)
        own = three.back[longer]
        each[longer] = part[own] + self._rest(self.left[three.own[own]], 1) * each[longer]
        count = known.count[known.tokens]
        return {
            "n_tokens": np.diff(bound),
            "n_known": words.sums(count > 0, bound).astype(np.int64),
            "train_tokens": np.full(len(bound) - 1, known.n, dtype=np.int64),
            "base_score": words.sums(np.log10((count + 1) / (known.n + known.v + 1)), bound),
            "score": words.sums(np.log10(each), bound),
        }


def lm_scores(docs: DataFrame, carry: tuple[str, ...] = (), mass: tuple[float, float] = MASS) -> DataFrame:
    """doc_id, the carried columns, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of docs.

    Tokens are the words of the text in lower case (A-Z), then one end; a null text is empty. The model learns from the
    documents whose crc32(doc_id as text) mod 7 is not 2; a null doc_id is not held out. Repeated rows count and come out
    each. An empty table gives no rows; without training documents every probability is one. Counts
    cover the whole corpus and whole texts. Columns that are not carried are not read; carried ones must not clash.
    """
    rows, count, total = batches.deal(docs, carry)
    shards = batches.shards(docs, total)

    def bigrams(g: int, t: pa.Table, got: dict[int, bytes]) -> list[tuple[int, bytes]]:
        return [(shards + s, b) for s, b in Texts(t, got, shards, mass).two.questions()]

    def trigrams(g: int, t: pa.Table, got: dict[int, bytes]) -> list[tuple[int, bytes]]:
        texts = Texts(t, got, shards, mass)
        texts.extend(got)
        return [(2 * shards + s, b) for s, b in texts.three.questions()]

    one = batches.answer(batches.ask(rows, lambda g, t: _ask_words(Batch.of(t), shards)), count, lambda s, asked: _answer_words(s, asked, shards))
    two = one.unionByName(batches.answer(batches.ask(rows, bigrams, one), count, lambda s, asked: _answer(asked, mass[0], last=False)))
    three = two.unionByName(batches.answer(batches.ask(rows, trigrams, two), count, lambda s, asked: _answer(asked, mass[1], last=True)))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, got = batches.opened(left), batches.bodies(right)
        texts = Texts(left, got, shards, mass)
        texts.extend(got)
        out = {c: left.column(c) for c in ("doc_id", *carry)}
        out["held_out"] = pa.array(_held_out(left.column("doc_id").to_pylist()))
        return pa.table(out | {k: pa.array(x) for k, x in texts.score(got).items()})

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = [*(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)), "held_out boolean", "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"]
    return rows.groupBy("g").cogroup(three.groupBy("g")).applyInArrow(run, ", ".join(schema))
