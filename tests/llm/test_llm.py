"""Small tests of every operator: edge cases, and brute force where SQL cannot say what is right."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import ann, batches, bpe, components, decontaminate, elias_fano, licenses, lm_trie, quality, sharding, simhash, substring, toxicity, words

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASH = ["g", "shard", "body", "node", "key", "root", "rank", "words", "score", "run", "n", "f0", "size", "pairs", "predicted"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASH)])


def _docs(spark, data):
    return spark.createDataFrame([(i, t, "en", None, *CLASH) for i, t in data], SCHEMA)


def _vocabulary(n=60):
    r = random.Random(5)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def edge():
    """Nulls, empty and blank texts, repeated rows, ties, one very long text, near copies."""
    r, v = random.Random(1), _vocabulary()
    base = [" ".join(r.choice(v) for _ in range(40)) for _ in range(6)]
    long = " ".join(r.choice(v) for _ in range(30_000))
    near = base[0].split()
    near[20] = "Changed"
    return [(1, base[0]), (2, base[0].upper()), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (None, base[1]), (7, base[1]), (7, base[1]), (8, long), (9, base[2] + " " + base[3]), (10, base[4] + "\n" + base[3]), (11, "one two"), (None, None), (12, "naïve Étion — 中文 \x00 \x1c end")]


@pytest.fixture
def empty(spark):
    return _docs(spark, [])


def test_words_match_split():
    data = ["a b", "", "  x\ty\x0bz ", "é f g", "w"]
    w = [x for _, _, d, o in words.texts(pa.array(data)) for x in [words.split(d, o, True)]][0]
    got = [[w.data[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.bound, w.bound[1:])]
    assert got == [t.encode().lower().split() for t in data]
    assert len(set(w.hashes().tolist())) == len({x for g in got for x in g})
    key, place = words.numbered(w.digests())
    assert (key[place] == w.digests()).all() and len(key) == len(set(w.hashes().tolist()))
    clash = np.array([[5, 2], [5, 1], [3, 9], [5, 2]], np.uint64)
    assert words.numbered(clash)[0].tolist() == [[3, 9], [5, 1], [5, 2]] and words.numbered(clash)[1].tolist() == [2, 1, 0, 2]


def test_components_against_union_find(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(None, 1), (3, 3)]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and {x for p in links[:45] for x in p if p[0] != p[1]} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 ------------------------------------------------------------------------------------------
def test_hilbert_steps_are_adjacent():
    n, states, steps = 3, 24, sharding._steps(3)

    def index(cell):
        h = s = 0
        for k in (1, 0):
            f = steps[s * 8 + sum(((cell[i] >> k) & 1) << i for i in range(n))]
            h, s = h * 8 + f // states, f % states
        return h

    cells = sorted(((a, b, c) for a in range(4) for b in range(4) for c in range(4)), key=index)
    assert sorted(map(index, cells)) == list(range(64))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))


def test_hilbert_index_fills_the_cube_step_by_step(spark):
    side = 8
    cube = spark.range(side**3).selectExpr("cast(id div 64 as int) as a", "cast(id div 8 % 8 as int) as b", "cast(id % 8 as int) as c")
    got = cube.select("a", "b", "c", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(side**3))
    assert all(abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) == 1 for p, q in zip(got, got[1:]))


def test_written_shards_prune_by_each_dimension(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 40)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)
    size = F.octet_length("text")
    span = back.groupBy("shard").agg(*[f(c).alias(n + k) for n, c in (("source", F.col("source")), ("lang", F.col("lang")), ("size", size)) for k, f in (("_lo", F.min), ("_hi", F.max))]).collect()
    rows = docs.select("source", "lang", size.alias("size")).collect()
    for name in ("source", "lang", "size"):
        values = sorted(r[name] for r in rows if r[name] is not None)
        probes = values[:: len(values) // 50]
        met = sum(s[name + "_lo"] is not None and s[name + "_lo"] <= x <= s[name + "_hi"] for x in probes for s in span) / (40 * len(probes))
        assert met < 0.75, (name, met)


def test_hilbert_shards(spark, edge, empty):
    got = sharding.hilbert_shards(_docs(spark, edge), 4).collect()
    assert len(got) == len(edge) and sharding.hilbert_shards(empty, 4).count() == 0
    by = Counter(r.shard for r in got)
    assert max(by.values()) - min(by.values()) <= 1 and set(by) == {0, 1, 2, 3}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by.items())
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in edge)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want


# ---- 2 ------------------------------------------------------------------------------------------
def test_elias_fano_and_trie():
    r = np.random.default_rng(0)
    for n, top in ((1, 10), (500, 4000), (2000, (1 << 64) - 1)):
        v = np.unique(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
        ef = elias_fano.EliasFano(v, top)
        q = np.concatenate([v, r.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
        at, found = ef.successor(q)
        assert (ef.access(np.arange(len(v))) == v).all() and (found == np.isin(q, v)).all() and (v[at[found]] == q[found]).all()
    contexts, followers = np.array([5, 9, 70], np.uint64), np.array([1, 7, 7, 3], np.uint64)
    trie = elias_fano.Level(contexts, followers, np.array([0, 0, 1, 2]), elias_fano.quantised(np.array([0.5, 0.25, 1.0, 1e-3])))
    at, found = trie.search(np.array([5, 6, 9], np.uint64), np.array([1, 7, 7, 7, 3, 900], np.uint64), np.array([0, 0, 1, 2, 2, 0]))
    assert found.tolist() == [True, True, False, True, False, False] and np.allclose(elias_fano.value(trie.codes[at[found]]), [0.5, 0.25, 1.0], rtol=1e-3)
    one = elias_fano.Level(np.zeros(1, np.uint64), np.array([3, 1 << 63], np.uint64), np.zeros(2, np.int64), np.array([7, 8], "<u2"))
    assert one.search(np.zeros(1, np.uint64), np.array([3, 4, 1 << 63], np.uint64), np.zeros(3, np.int64))[1].tolist() == [True, False, True]


def test_lm_scores_against_dictionaries(spark, edge, empty):
    got = lm_trie.lm_scores(_docs(spark, edge)).collect()
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in edge]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [d for i, d in docs if not held(i)]
    c = Counter(w for d in train for w in d)
    pair = Counter(z for d in train for z in zip([0] + d[:-1], d))
    three = Counter(z for d in train for z in zip([0] + d[:-2], d[:-1], d[1:]))
    n, v = sum(c.values()), len(c)

    def score(d):
        s = 0.0
        for j, w in enumerate(d):
            a = d[j - 1] if j else 0
            k = c[a] if j else c[None]
            m = lm_trie.MASS[0] * math.sqrt(k + 1)
            p = (c[w] - lm_trie.DISCOUNT) / n if c[w] else lm_trie.DISCOUNT * v / n
            p = pair[a, w] / (k + m) + m / (k + m) * p
            if j:
                b = d[j - 2] if j > 1 else 0
                k = pair[b, a]
                m = lm_trie.MASS[1] * math.sqrt(k + 1)
                p = three[b, a, w] / (k + m) + m / (k + m) * p
            s += math.log10(p)
        return s

    want = sorted((str(i), held(i), len(d), sum(c[w] > 0 for w in d), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d), 4)) for i, d in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    by = {str(i): score(d) for i, d in docs if i is not None}
    assert all(abs(by[str(r.doc_id)] - r.score) <= 2e-4 * r.n_tokens for r in got if r.doc_id is not None)
    assert lm_trie.lm_scores(empty).count() == 0


def _alike():
    """Two words of 1,024 bytes whose polynomial hashes modulo 2**64 are equal for every odd base."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomial_hashes_are_told_apart(spark):
    same = " ".join(f"w{k}" for k in range(12))
    data = [(i, f"{same} {w}") for i, w in zip((4, 9), _alike())]
    assert all(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in data)
    got = lm_trie.lm_scores(_docs(spark, data)).collect()
    c = Counter({f"w{k}": 2 for k in range(12)} | {None: 2})
    want = (sum(math.log10((k + 1) / (28 + 15 + 1)) for k in c.values()) + math.log10(2 / 44)) if len(c) else 0
    assert all(abs(r.base_score - want) < 1e-9 and r.train_tokens == 28 for r in got)
    assert all(r.n_removed == 0 for r in substring.dedup_substrings(_docs(spark, data)).collect())


def test_packed_questions_grow_in_proportion():
    for total in (10**9, 10**11, 10**13, 10**14):
        rows = (total / batches.unit(total, 12 << 20)) * (total / batches.unit(total, 8 << 20))
        assert rows <= 1.01 * total / batches.PACKET


# ---- 3 and 5 --------------------------------------------------------------------------------------
@pytest.mark.parametrize("scores, name", [(toxicity.toxicity_scores, "toxicity_score"), (quality.quality_scores, "quality_score")])
def test_classifiers_on_edges(spark, edge, empty, scores, name):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (8, 1, 0), (None, 1, 1), (9, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = scores(_docs(spark, edge), labels, ("lang",)).collect()
    assert len(got) == len(edge) and all(0 <= r[name] <= 1 for r in got)
    none = scores(_docs(spark, edge), labels.limit(0)).collect()
    assert all(r[name] == 0.5 for r in none) and scores(empty, labels).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.with_decision(quality.quality_scores(docs, labels), 0.7).join(labels, "doc_id")
    hits = [r.predicted == r.quality for r in got.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(hits) >= 0.93 * len(hits)


def test_toxicity_learns_words():
    r, v = random.Random(4), _vocabulary(400)
    plain = [" ".join(r.choice(v) for _ in range(40)) for _ in range(400)]
    toxic = [t.replace(" ", " horridword ", 1).replace("  ", " ") + " vilething" for t in plain[:80]]
    model = toxicity.train(plain[:200] + toxic[:50], [0] * 200 + [1] * 50)
    import pickle

    a, b, curve = pickle.loads(model)
    x = toxicity.evidence(pa.array(plain[200:] + toxic[50:]), toxicity.Distance(a, b), {})
    z = x @ np.array(curve[:-1]) + curve[-1]
    assert np.median(z[200:]) > np.quantile(z[:200], 0.9)


# ---- 4 ------------------------------------------------------------------------------------------
def _tiktoken():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return p, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, edge, empty):
    p, enc = _tiktoken()
    args = (p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    extra = [(20, "x" * 5000 + " " + "ab" * 900), (21, "don't  I'll\n\n 3.14 "), (22, "<|endoftext|> a\x85b　c")]
    docs = _docs(spark, edge + extra)
    got = bpe.bpe_encode(docs, *args, carry=("lang",)).collect()
    want = Counter((str(i), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in edge + extra)
    assert Counter((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    back = bpe.bpe_decode(bpe.bpe_encode(docs, *args), *args).collect()
    assert Counter((str(r.doc_id), bytes(r.decoded)) for r in back) == Counter((a, c) for (a, _, c), k in want.items() for _ in range(k))
    assert bpe.bpe_encode(empty, *args).count() == 0


# ---- 6 ------------------------------------------------------------------------------------------
def test_license_scan(spark, edge, empty):
    notices = {f: t[0] for f, t in licenses.TEMPLATES.items()}
    more = [(100 + k, f"{edge[0][1]}\n{t}\n{edge[9][1][:200]}") for k, t in enumerate(notices.values())]
    got = licenses.license_scan(_docs(spark, edge + more)).collect()
    assert {(r.doc_id, r.family) for r in got if r.doc_id and r.doc_id >= 100} == {(100 + k, f) for k, f in enumerate(notices)}
    assert all(r.paragraph == 1 and r.agreement == 1 for r in got) and len(got) == len(notices)
    assert licenses.license_scan(empty).count() == 0


def test_license_scan_of_other_wordings(spark, edge):
    said = {
        "MIT": "This library is licensed under the terms of the MIT license, see the file.",
        "Apache-2.0": "Code is licensed under the Apache License, Version 2.0 by its authors",
        "GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
        "AGPL-3.0": "This tool is licensed under the GNU Affero General Public License, version 3.",
        "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    }
    none = ["The shop needs a license for the public sale of free drinks.", "Permission is granted to visitors who use the pool.", "SPDX-License-Identifier: Proprietary-Foo", "All files of the work are provided by the city."]
    data = [(100 + k, t) for k, t in enumerate(said.values())] + [(200 + k, t) for k, t in enumerate(none)] + [(300, " ".join(["word"] * 20000) + " released under the ISC License. " + " ".join(["word"] * 20000))]
    got = licenses.license_scan(_docs(spark, edge + data)).collect()
    assert {r.doc_id: r.family for r in got} == {100 + k: f for k, f in enumerate(said)} | {300: "ISC"}


# ---- 7 ------------------------------------------------------------------------------------------
def test_simhash_against_all_pairs(spark, edge, empty):
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 4))) for p in prints]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p, p) for p in dict.fromkeys(signed)], "node long, f0 long")
    got = simhash.components(simhash.close_pairs(fps, 64, 3, 2)).collect()
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in got} == {x: find(x) for p in near for x in p}
    out = simhash.simhash_components(_docs(spark, edge)).collect()
    assert len(out) == len(edge) and simhash.simhash_components(empty).count() == 0
    comp = {r.doc_id: r.component_id for r in out if r.doc_id}
    assert comp[2] == 1 and comp[4] == comp[5] == comp[6] == 4 and [r.component_id for r in out if r.doc_id is None and r.f0 != 0] == [7]


def test_near_duplicates(spark, edge, empty):
    r, v = random.Random(6), _vocabulary(500)
    base = [r.choice(v) for _ in range(300)]
    data = []
    for k in range(30):
        w = list(base)
        w[r.randrange(300)] = f"edit{k}"
        data.append((100 + k, " ".join(w)))
    other = [r.choice(v) for _ in range(300)]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(_docs(spark, edge + data + [(200, " ".join(other))])).collect()}
    assert all(got[100 + k] == 100 for k in range(30)) and got[200] == 200 and got[2] == 1 and got[7] == 7 and got[10] == 10
    assert simhash.near_duplicates(empty).count() == 0


def _shingles(text, size):
    words = text.encode().lower().split()
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)}


def test_fingerprint_bit_by_bit():
    import xxhash

    for text in ("One two three four FIVE two", "a b", "", None, "a b c " * 40):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_of_block_edits(spark):
    r, v = random.Random(16), _vocabulary(3000)
    text = lambda n: [r.choice(v) for _ in range(n)]
    data, want = [], {}
    for k in range(40):
        n = r.choice([12, 30, 100, 400])
        w = text(n)
        at = r.randrange(n - n // 10)
        edits = [w + text(max(1, n // 6)), w[:at] + text(n // 12) + w[at + n // 12 :], w[: n - n // 7], text(1) + w]
        for j, words in enumerate([w, *edits]):
            data.append((10 * k + j, " ".join(words)))
            one, two = _shingles(data[5 * k][1], 5), _shingles(data[-1][1], 5)
            want[10 * k + j] = len(one & two) >= 0.8 * len(one | two)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(_docs(spark, data)).collect()}
    assert sum(want.values()) > 120 and all(got[i] == i // 10 * 10 for i, near in want.items() if near)


def test_near_duplicates_of_periodic_texts(spark):
    data = [(1, "a " * 1000), (2, "a " * 1001), (3, "a b c " * 30), (4, "a b c " * 40), (5, "a b d " * 30), (6, "a b c"), (7, "b a c")]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(_docs(spark, data)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "four five six")], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == ["four five six", "one two three"]


# ---- 8 ------------------------------------------------------------------------------------------
def test_nearest_recall_and_edges(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    odd = spark.createDataFrame([(5000, None, 0), (5050, [0.0] * 64, 0), (5100, [float("nan")] + [1.0] * 63, 0), (None, [1.0] * 64, 0), (5150, [None] + [1.0] * 63, 0), (5200, [], 0)], v.schema)
    same = v.where("vec_id = 50").select(F.explode(F.expr("sequence(10001L, 10031L)")).alias("vec_id"), "embedding", "label")
    every = v.unionByName(odd).unionByName(same)
    got = ann.nearest(every, 50, 5).collect()
    pdf = v.unionByName(same).toPandas()
    ids, m = pdf.vec_id.values, np.array(pdf.embedding.tolist(), dtype=float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort([ids, -np.round(s, 12)])[:5]]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(best.tolist())), total + 5
    assert hits >= 0.9 * total
    assert ann.nearest(v.limit(0)).count() == 0 and ann.nearest(v.where("vec_id in (0, 1, 2)")).count() == 2


def test_nearest_in_several_regions(spark, monkeypatch):
    monkeypatch.setattr(ann, "REGION", 500)
    r = np.random.default_rng(3)
    m = r.standard_normal((40, 24))[r.integers(0, 40, 6000)] + 0.6 * r.standard_normal((6000, 24))
    m[1000:2500] = m[7]  # a quarter are copies of one
    got = ann.nearest(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>"), 50, 5).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        best = np.lexsort([np.arange(6000), -s])[:5]
        mine = [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)]
        hits += len({*mine} & {*best.tolist()})
    assert len(got) == 600 and hits >= 0.9 * 600


def test_nearest_ties_and_extreme_lengths(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal(16)
    data = [(0, r.standard_normal(16)), *((10 + k, base * 2.0 ** (20 - k)) for k in range(20)), (50, base), (60, base * 2.0**-660), (61, base * 2.0**660), (62, np.append(base, 0.0)), (63, r.standard_normal(3))]
    got = ann.nearest(spark.createDataFrame([(k, list(map(float, x))) for k, x in data], "vec_id long, embedding array<double>"), 50, 5).collect()
    by = {q: [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] for q in (0, 50)}
    assert by[50] == [10, 11, 12, 13, 14] and len(by[0]) == 5 and all(abs(x.score - 1) < 1e-12 for x in got if x.query_id == 50)


# ---- 9 ------------------------------------------------------------------------------------------
def test_contaminated(spark, edge, empty):
    r, v = random.Random(8), _vocabulary(300)
    item = [r.choice(v) for _ in range(30)]
    swapped = list(item)
    swapped[9] = swapped[21] = "other"
    filler = [r.choice(v) for _ in range(100)]
    data = [(300, " ".join(filler[:50] + item + filler[50:])), (301, " ".join(filler[:9] + swapped).upper() + "."), (302, " ".join(filler)), (303, " ".join(item[8:24]))]
    tests = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (None, "a b", "x"), (3, "", "x")], "item_id long, text string, words string")
    got = {x.doc_id: x for x in decontaminate.contaminated(_docs(spark, edge + data), tests).collect()}
    assert set(got) == {300, 301, 303} and got[300].matched == 30 and got[300].first_word == 50 and got[301].matched == 28 and got[303].first_word == -8
    assert decontaminate.contaminated(empty, tests).count() == 0 and decontaminate.contaminated(_docs(spark, data), tests.limit(0)).count() == 0


def _holds(words, item):
    """Brute force: the best (matched, -place) of an alignment with 11 of 13 equal words (all words in that proportion if fewer)."""
    wide, best = min(13, len(item)), None
    for at in range(1 - len(item), len(words)):
        low, high = max(0, -at), min(len(item), len(words) - at)
        equal = [words[at + k] == item[k] for k in range(low, high)]
        if any(sum(equal[k : k + wide]) >= math.ceil(wide * 11 / 13) for k in range(len(equal) - wide + 1)):
            best = max(best or (0, 0), (sum(equal), -at))
    return best


def test_contaminated_by_every_substitution(spark):
    r = random.Random(18)
    items = {k: [f"i{k}w{j}" for j in range(k)] for k in range(1, 14)}
    filler = [f"f{k}" for k in range(20)]
    texts = []
    for n, item in items.items():
        texts.append(filler + item + filler)
        places = [(a,) for a in range(n)] + ([(a, b) for a in range(n) for b in range(a + 1, n)] if n in (7, 12, 13) else [])
        for gone in places:
            texts.append(filler[: r.randrange(3)] + [f"x{k}" if k in gone else w for k, w in enumerate(item)] + filler[:2])
    texts += [items[13][3:], items[6][1:], items[9][:8], []]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    want = {(k, n, *best) for k, t in enumerate(texts) for n, item in items.items() if (best := _holds(t, item))}
    got = {(x.doc_id, x.item_id, x.matched, -x.first_word) for x in decontaminate.contaminated(docs, tests).collect()}
    shuffled = {(x.doc_id, x.item_id, x.matched, -x.first_word) for x in decontaminate.contaminated(docs, tests, most_seeds=0).collect()}
    assert shuffled == want
    assert got == want and sum(len(texts[k]) < 20 and n == 13 for k, n, *_ in want) == 13 + 78


# ---- 10 -----------------------------------------------------------------------------------------
def _strip(data, size=13):
    key = lambda i: math.inf if i is None else i
    docs = [(i, (t or "").encode().split()) for i, t in data]
    first = {}
    for i, w in docs:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, math.inf), key(i))
    out = []
    for i, w in docs:
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < key(i) for j in range(k, k + size)}
        out.append((str(i), len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out)


def test_dedup_substrings_against_brute_force(spark, edge, empty):
    r = random.Random(12)
    shared = [" ".join(f"w{r.randrange(40)}" for _ in range(60)) for _ in range(4)]
    data = edge + [(400 + k, f"{shared[k % 4]} only{k} {shared[(k + 1) % 4][:90]}") for k in range(40)] + [(500, "a " * 50), (501, "a " * 80)]
    got = substring.dedup_substrings(_docs(spark, data), 13, carry=("lang",))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == _strip(data)
    assert substring.dedup_substrings(empty).count() == 0
    whole = {r.doc_id: r.kept_text for r in substring.dedup_substrings(_docs(spark, edge), whole=True).collect()}
    assert whole[6] == " \n\t "


# ---- pipeline -------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in p.STAGES] and len(p.STAGES) == 5
    _, enc = _tiktoken()
    seen = [docs]
    for _, stage in p.STAGES:
        out = stage(spark, seen[-1], SF)
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    for s in seen[:-1]:
        assert set(s.columns) == set(docs.columns)
    ids = [[r.doc_id for r in s.collect()] for s in seen]
    assert all(len(set(x)) == len(x) for x in ids[2:]) and all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    kept = {r.doc_id: r.text for r in seen[2].collect()}
    copies = Counter(" ".join(t.lower().split()) for t in kept.values())
    assert max(copies.values()) == 1
    want = {i: n for i, _, n, _ in _strip(list(kept.items()))}
    for r in seen[3].collect():
        assert (r.text == kept[r.doc_id]) == (want[str(r.doc_id)] == 0) and r.n_chars == len(r.text)
    last = {r.doc_id: r.text for r in seen[4].collect()}
    for r in seen[5].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(last[r.doc_id]) and r.text == last[r.doc_id]
    assert len(ids[-1]) > 0.5 * len(text)
