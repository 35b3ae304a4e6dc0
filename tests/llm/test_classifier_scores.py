"""The scores of the quality and toxicity classifiers, computed again word by word."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tessera.llm import quality, toxicity, words

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def word_hash(w):
    one, two = (int(x) for x in words.ODD)
    h = mix((len(w) * one + two) & M)
    for k in range(0, len(w), 8):
        h = mix((h ^ int.from_bytes(w[k : k + 8], "little")) * one & M)
    return h


def buckets(text):
    h = [word_hash(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", text.encode())]
    two = [0x5EED if a == b else mix((a * 3 + b) & M) for a, b in zip(h, h[1:])]
    return [x % quality.BUCKETS for x in h + two]


TEXTS = ["", " \n", "one", "one one one", "Mixed, words... and (signs) é中文 x1", "a" * 40 + " tail", "\x00 \x1c"] + [" ".join(random.Random(k).choice(["up", "down", "left,", "right", "longer-word"]) for _ in range(k)) for k in range(1, 40, 5)]


def test_quality_scores():
    w = np.random.default_rng(3).standard_normal(quality.BUCKETS + 1).astype(np.float32)
    got = quality.score(pa.array([*TEXTS, None]), w.tobytes())
    for text, s in zip([*TEXTS, ""], got, strict=True):
        f = buckets(text)
        z = 10 * sum(float(w[k]) for k in f) / max(1, len(f)) + float(w[-1])
        assert abs(s - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_ftrl_updates():
    texts, labels = ["good text here", "bad bad text", "good one", ""], [1, 0, 1, 0]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.02
    rows = []
    for text, y in zip(texts, labels):
        f = buckets(text)
        rows.append(({k: 10 * f.count(k) / max(1, len(f)) for k in f} | {quality.BUCKETS: 1.0}, y))
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    got = np.frombuffer(quality.train(texts, labels), dtype=np.float32)
    assert all(abs(got[k] - weight(k)) < 1e-5 for k in z) and np.count_nonzero(got) == sum(weight(k) != 0 for k in z)


@pytest.mark.parametrize("trained", [True, False])
def test_toxicity_evidence(trained):
    r = random.Random(1)
    toxic = [f"{r.choice('bdfg')}{r.choice('aeiou')}rk{k % 40}" for k in range(400)]
    plain = [f"{r.choice('lmns')}{r.choice('aeiou')}nt{k % 90}" for k in range(900)]
    made = [zstandard.train_dictionary(n, [f" {w} ".encode() for w in own]).as_bytes() if trained else b"" for n, own in ((1000, toxic), (3000, plain))]
    texts = [" ".join(r.choice(toxic + plain) for _ in range(n)) for n in (0, 1, 5, 60, 400)] + ["UPPER " + toxic[0].upper(), "é  x"]
    size = lambda d, w: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress((b" " + w) * toxicity.REPEATS + b" "))
    got = toxicity.evidence(pa.array([*texts, None]), toxicity.Distance(*made), {})
    for text, x in zip([*texts, ""], got, strict=True):
        own = [w.encode() for w in re.findall(r"[^ \t-\r]+", text.translate({c: c + 32 for c in range(65, 91)}))]
        d = [size(made[1], w) - size(made[0], w) if trained else 0 for w in own]
        want = [math.log((sum(math.exp(2 * k) for k in d) + 1) / (len(d) + 1)), math.log1p(len(d)), math.log1p(sum(k >= 3 for k in d))]
        assert np.allclose(x, want, atol=1e-9)


def test_logistic_curve_has_no_slope_left():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 3))
    y = (x @ np.array([1.0, -2.0, 0.5]) + r.standard_normal(300) > 0.3).astype(float)
    beta = np.array(toxicity._logistic(x, y))
    z = np.column_stack([x, np.ones(300)])
    assert np.abs(z.T @ (y - 1 / (1 + np.exp(-z @ beta))) - 1e-3 * beta).max() < 1e-6
