"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A window of a text (one word, written out a few
times so that the fixed cost of a block cancels) is compressed with either; the window's distance is how many bytes
fewer the toxic dictionary needs. A text's evidence is the log of the mean of exp(2 distance) over all its windows; a
logistic curve fitted on training texts turns it into a probability, so a threshold on it is calibrated.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import labelled, words
from tessera.llm.simhash import BANDS, sketch

#: Most labelled texts that training reads, and the dictionaries' sizes in bytes: the bounds of training and of the model.
TRAIN_ROWS = 4000
TOXIC_BYTES, ORDINARY_BYTES = 4096, 110_000
REPEATS, LEVEL, FOLDS = 6, 19, 4
#: A toxic training string stands in so many toxic texts, in this share of them, and so many times as often as in ordinary ones.
LEAST, SHARE, RATIO = 4, 0.01, 15


def _window(word: bytes) -> bytes:
    return (b" " + word) * REPEATS + b" "


class Distance:
    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        import zstandard

        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress if d else None
        self.toxic, self.ordinary = make(toxic), make(ordinary)

    def of(self, word: bytes) -> int:
        if self.toxic is None or self.ordinary is None:
            return 0
        x = _window(word)
        return len(self.ordinary(x)) - len(self.toxic(x))


def evidence(column: pa.Array, distance: Distance, memo: dict[int, int]) -> np.ndarray:
    """One row of features for each text. memo: the distances of words seen before, by hash; it is emptied when large."""
    out = np.zeros((len(column), 3))
    for a, b, data, offsets in words.texts(column):
        w = words.split(data, offsets, lower=True)
        h, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(memo) > 1_000_000:
            memo.clear()
        raw = w.data.tobytes()
        each = np.empty(len(h))
        for k, (x, s, e) in enumerate(zip(h.tolist(), w.start[first].tolist(), w.end[first].tolist(), strict=True)):
            got = memo.get(x)
            if got is None:
                got = memo[x] = distance.of(raw[s:e])
            each[k] = got
        n = np.diff(w.bound)
        each = each[back]
        top = np.zeros(len(n))
        np.maximum.at(top, np.repeat(np.arange(len(n)), n), each)
        power = np.exp(2 * (each - np.repeat(top, n)))  # no larger than one, however long a word is
        out[a:b, 0] = 2 * top + np.log((words.sums(power, w.bound) + np.exp(-2 * top)) / (n + 1))
        out[a:b, 1] = np.log1p(n)
        out[a:b, 2] = np.log1p(words.sums((each >= 3).astype(float), w.bound))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> list[float]:
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        beta += np.linalg.solve(curve, x.T @ (y - p) - 1e-3 * beta)
    return beta.tolist()


def _apart(sets: list[set[bytes]], labels: list[int]) -> list[int]:
    """One of each group of texts of one label whose sets of words have a Jaccard similarity of 0.8 or more: copies say nothing more of the class."""
    kept: list[int] = []
    buckets: dict[tuple[int, int, bytes], list[int]] = {}
    for k, own in enumerate(sets):
        low = sketch(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))).reshape(BANDS, -1)
        keys = [(labels[k], b, x.tobytes()) for b, x in enumerate(low)]
        near = {j for key in keys for j in buckets.get(key, ())}
        if any(5 * len(own & sets[j]) >= 4 * len(own | sets[j]) for j in near):
            continue
        kept.append(k)
        for key in keys:
            buckets.setdefault(key, []).append(k)
    return kept


def _dictionaries(sets: list[set[bytes]], labels: list[int], rows: list[int]) -> list[bytes]:
    """The toxic and the ordinary dictionary, from windows that stand out in either class; empty ones if there are too few."""
    import zstandard

    many = [sum(labels[k] == y for k in rows) for y in (0, 1)]
    seen = [Counter(w for k in rows if labels[k] == y for w in sets[k]) for y in (0, 1)]
    marks = sorted(w for w, n in seen[1].items() if n >= max(LEAST, SHARE * many[1]) and n / max(1, many[1]) >= RATIO * (seen[0][w] + 0.5) / max(1, many[0]))
    plain = sorted(w for w, n in seen[0].items() if n >= LEAST and w not in set(marks))
    made = []  # the trainer keeps its last samples for a trial of its own, so each string comes in every turn
    for own, n, most, size in ((marks, seen[1], 20, TOXIC_BYTES), (plain, seen[0], 5, ORDINARY_BYTES)):
        try:
            made.append(zstandard.train_dictionary(size, [b" " + w + b" " for turn in range(most) for w in own if n[w] > turn]).as_bytes())
        except (zstandard.ZstdError, ValueError):
            made.append(b"")
    return made


def train(texts: list[str], labels: list[int]) -> bytes:
    """Both dictionaries, learned from all texts, and the curve, learned from evidence by dictionaries of the other folds; pickled."""
    sets = [set(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    apart = _apart(sets, labels)
    x = np.zeros((len(texts), 3))
    for fold in range(FOLDS):
        own = [k for k in range(len(texts)) if k % FOLDS == fold]
        others = [k for k in apart if k % FOLDS != fold]
        x[own] = evidence(pa.array([texts[k] for k in own], pa.large_string()), Distance(*_dictionaries(sets, labels, others)), {})
    curve = _logistic(x, np.array(labels, dtype=float)) if texts else [0.0] * 4
    return pickle.dumps((*_dictionaries(sets, labels, apart), curve))


def toxicity_scores(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs' doc_id, text and the carried columns, with toxicity_score: the probability that labels.toxic is 1.

    Learns from `train_rows` labelled texts at most that are not held out (labelled.fit), of near copies from one; every window of every whole
    text is compared. A null or empty text has no windows and no evidence. Repeated rows are scored each; an empty table
    gives no rows; without labels the score is 0.5. Columns that are not carried are not read, whatever their names.
    """
    model = labelled.fit(docs, labels, "toxic", train_rows, train)
    rows = docs.select("doc_id", "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary, curve = pickle.loads(model)
        distance, memo = Distance(toxic, ordinary), {}
        beta = np.array(curve)
        for b in batches:
            z = evidence(b.column(1), distance, memo) @ beta[:-1] + beta[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*b.schema.names, "toxicity_score"])

    return rows.mapInArrow(run, labelled.plus(rows, "toxicity_score"))


def with_decision(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Adds predicted: 1 at the threshold or above."""
    return scored.withColumn("predicted", (F.col("toxicity_score") >= threshold).cast("int"))
