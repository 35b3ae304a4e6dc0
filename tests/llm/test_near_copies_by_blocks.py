"""Large groups of texts that are nearly near copies: the links of all their pairs, without a row for each pair."""

import numpy as np
import pyarrow as pa

from tessera.llm import scratch, simhash


def edited(count: int, seed: int = 5) -> list[str]:
    """Copies of one text of 150 words in which 1 to 4 words are replaced, so that the shingles of few pairs agree in 0.8."""
    r = np.random.default_rng(seed)
    base = [f"word{k}" for k in range(150)]
    out = []
    for _ in range(count):
        own = list(base)
        for at in r.choice(150, r.integers(1, 5), replace=False):
            own[at] = f"new{r.integers(40)}"
        out.append(" ".join(own))
    return out


def brute(texts: list[str]) -> list[int]:
    sets = [set(simhash._shingle_hashes(w[:, 0], 5).tolist()) for w in simhash._word_hashes(pa.array(texts))]
    root = list(range(len(texts)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(texts))]


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 64, raising=False)
    texts, pairs, cut = edited(240), [0], scratch.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash.scratch, "cut", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()}
    want = brute(texts)
    assert [got[k] for k in range(len(texts))] == want and 20 < len(set(want)) < 235
    assert max(pairs) < 20 * len(texts) < 240 * 239 // 4


def test_links_of_a_block(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    r = np.random.default_rng(1)
    sets = [np.unique(np.where(r.random(30) < 0.12, r.integers(100, 140, 30), np.arange(30))) for _ in range(60)]
    roots, sides = r.integers(0, 40, 60), r.integers(0, 2, 60)
    for side in (None, sides):
        full = np.array([[roots[a] != roots[b] and (side is None or side[a] != side[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for b in range(60)] for a in range(60)])
        links = simhash.block_links(sets, roots, side, 0.8)
        assert all(full[a, b] for a, b in links) and 10 < len(links) < 60
        reach = lambda m: np.linalg.matrix_power(m.astype(float) + np.eye(60), 60) > 0
        own = np.zeros((60, 60), bool)
        for a, b in links:
            own[a, b] = own[b, a] = True
        assert (reach(own) == reach(full)).all()
