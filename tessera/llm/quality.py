"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled, scratch, words

#: Hash buckets of the features: the bound of the model's size (4 bytes each).
BUCKETS = 1 << 18
#: Most labelled texts that training reads.
TRAIN_ROWS = 4000
EPOCHS = 4

_KIND = np.full(256, 2, dtype=np.uint8)  # other marks
_KIND[words.SPACE] = 0
_KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> words.Words:
    """Runs of letters, digits and non-ASCII bytes, and runs of other marks."""
    kind = _KIND[data]
    change = np.empty(len(data) + 1, dtype=bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    keep = kind[start] > 0 if len(data) else np.zeros(0, dtype=bool)
    start, end = start[keep], end[keep]
    return words.Words(data, start, end, np.searchsorted(start, offsets))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bound): the hashed unigrams, then bigrams, of each text; a bigram of two equal words is one feature whatever the word."""
    w = _tokens(data, offsets)
    h = w.hashes()
    n = np.diff(w.bound)
    one = h % words.U64(BUCKETS)
    if len(h) > 1:
        two = words.mix(h[:-1] * words.U64(3) + h[1:])
        two[h[:-1] == h[1:]] = words.U64(0x5EED)
        two %= words.U64(BUCKETS)
    else:
        two = np.zeros(0, dtype=words.U64)
    held = np.ones(len(two), dtype=bool)
    inner = w.bound[1:-1]
    held[inner[(inner > 0) & (inner < len(h))] - 1] = False  # no bigram over the edge of a text
    of = np.repeat(np.arange(len(n)), n)
    each = np.concatenate([one, two[held]]).astype(np.int64)
    owner = np.concatenate([of, of[:-1][held] if len(of) else of])
    order = np.argsort(owner, kind="stable")
    return each[order], np.searchsorted(owner[order], np.arange(len(n) + 1))


def train(texts: list[str], labels: list[int], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> bytes:
    """The weights, with the intercept last, as 32-bit floats."""
    w, z, g2 = (np.zeros(BUCKETS + 1) for _ in range(3))
    rows = []
    for a, b, data, offsets in words.texts(pa.array(texts, pa.large_string())):
        f, bound = features(data, offsets)
        for k in range(b - a):
            got, count = np.unique(f[bound[k] : bound[k + 1]], return_counts=True)
            rows.append((np.append(got, BUCKETS), np.append(10 * count / max(1, count.sum()), 1.0), labels[a + k]))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            f, x, y = rows[k]
            zf = z[f]
            wf = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(g2[f])) / alpha + l2))
            w[f] = wf
            g = (1 / (1 + np.exp(-np.clip(wf @ x, -30, 30))) - y) * x
            s = (np.sqrt(g2[f] + g * g) - np.sqrt(g2[f])) / alpha
            z[f] += g - s * wf
            g2[f] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))
    return w.astype(np.float32).tobytes()


def score(column: pa.Array, model: bytes) -> np.ndarray:
    """The probability of label 1 of each text of a column, by the weights of train()."""
    w = np.frombuffer(model, dtype=np.float32).astype(np.float64)
    out = np.zeros(len(column))
    for a, b, data, offsets in words.texts(column):
        f, bound = features(data, offsets)
        dot = 10 * words.sums(w[f], bound) / np.maximum(1, np.diff(bound)) + w[BUCKETS]
        out[a:b] = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs' doc_id, text and the carried columns, with quality_score: the probability that labels.quality is 1.

    Learns from `train_rows` labelled texts at most that are not held out (labelled.fit); every whole text is scored.
    A null or empty text has no features and gets the score of the intercept. Nulls in other columns pass through;
    repeated rows are scored each; an empty table gives no rows; without a label all weights are zero, the score 0.5.
    Columns that are not carried are not read, whatever their names.
    """
    model = labelled.fit(docs, labels, "quality", train_rows, train)
    rows = docs.select("doc_id", "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column(1), model))], [*b.schema.names, "quality_score"])
        scratch.release()

    return rows.mapInArrow(run, labelled.plus(rows, "quality_score"))


def with_decision(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds predicted: 1 at the threshold or above."""
    return scored.withColumn("predicted", (F.col("quality_score") >= threshold).cast("int"))
