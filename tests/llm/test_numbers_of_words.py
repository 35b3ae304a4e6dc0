"""What the language model's batches and tries do most: numbering words and selecting bits."""

import numpy as np
import pytest

from tessera.llm import elias_fano, words


def test_select_finds_every_set_bit():
    r = np.random.default_rng(3)
    given = np.concatenate([np.array([1, 1 << 63, (1 << 64) - 1], dtype=np.uint64), r.integers(0, 1 << 64, 300, dtype=np.uint64) & r.integers(0, 1 << 64, 300, dtype=np.uint64)])
    want = [(w, k, at) for w in given.tolist() for k, at in enumerate(b for b in range(64) if w >> b & 1)]
    word, k, at = (np.array(c, dtype=t) for c, t in zip(zip(*want, strict=True), (np.uint64, np.int64, np.int64), strict=True))
    assert (elias_fano._select(word, k) == at).all()


@pytest.mark.parametrize("same", [False, True])
def test_words_are_sorted_once_each(monkeypatch, same):
    r = np.random.default_rng(4)
    digests = r.integers(0, 1 << 64, (500, 2), dtype=np.uint64)[r.integers(0, 500, 20_000)]
    if same:  # words with equal first halves
        digests[:, 0] %= np.uint64(7)
    key, back = np.unique(digests, axis=0, return_inverse=True)
    sizes, plain = [0], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: sizes.append(len(x)) or plain(x, *a, **b))
    monkeypatch.setattr(np, "unique", None)
    got, place = words.numbered(digests)
    assert (got == key).all() and (place == back.reshape(-1)).all() and max(sizes) <= 500
