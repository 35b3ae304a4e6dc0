"""Walks, lookups of many terms and near duplicates against brute force."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import answering, gates, graph, similarity, traversal


def reached(pairs, start, depth):
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    found = {s: 0 for s in start if s is not None}
    edge = set(found)
    for hop in range(1, depth + 1):
        edge = {y for x in edge for y in near[x]} - set(found)
        found |= dict.fromkeys(edge, hop)
    return found


PATH = [(k, k + 1) for k in range(12)]
CYCLE = [(k, (k + 1) % 7) for k in range(7)]
STAR = [(0, k) for k in range(1, 40)] + [(5, 100), (100, 101)]


@pytest.mark.parametrize("pairs", [PATH, CYCLE, STAR, [], [(1, 1), (None, 1), (1, 2), (1, 2), (8, 9)]])
def test_walks_of_any_depth(spark, pairs):
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for start, depth in (([0], 0), ([0], 1), ([0, 0, None], 6), ([1, 8], 20)):
        first = spark.createDataFrame([(s,) for s in start], "id long")
        got = graph.k_hop(edges, first, depth)
        assert {r.id: r.hops for r in got.collect()} == reached(pairs, start, depth) and got.columns == ["id", "hops"]


def test_walks_with_keys_have_their_own_visits(spark):
    r = random.Random(1)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(28)]
    start = [("a", 1), ("a", 2), ("b", 1), ("c", 29)]
    got = traversal.walk(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(start, "term string, id long"), 4, ("term",)).collect()
    want = {(k, i, h) for k in "abc" for i, h in reached(pairs, [i for t, i in start if t == k], 4).items()}
    assert sorted(map(tuple, got)) == sorted(want)


def test_plan_does_not_grow_with_depth(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)], "src long, dst long")
    size = lambda d: len(graph.k_hop(edges, spark.createDataFrame([(0,)], "id long"), d)._jdf.queryExecution().optimizedPlan().toString())
    assert size(6) < 1.2 * size(1)


def test_neighborhood_is_limited_to_the_nearest(spark):
    nodes = spark.createDataFrame([(k, f"n{k}") for k in range(41)], "id long, name string")
    edges = spark.createDataFrame([(a, b, "T") for a, b in STAR] + [(1, 2, "T"), (1, 2, "T")], "src long, dst long, type string")
    near, inside = traversal.neighborhood(nodes, edges, nodes.where("id = 0"), 3, most=5)
    assert sorted((r.id, r.hops) for r in near.collect()) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)]
    assert sorted((r.src, r.dst) for r in inside.collect()) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2)]


def test_terms_against_brute_force(spark):
    r = random.Random(4)
    names = ["".join(r.choice("abAé ") for _ in range(r.randint(0, 8))) for _ in range(60)] + [None, "", "ab"]
    rows = [(k, n, r.random(), 0.5, r.choice([None, '{"k": "Zab"}', "{}"])) for k, n in enumerate(names)]
    nodes = spark.createDataFrame(rows, "id long, name string, quality_score double, confidence double, attributes string")
    terms = ["AB", "a", "", "b a", "zab", "éab", "nothing", None, "ab", "abab"]
    got = sorted(map(tuple, traversal.search_terms(nodes, spark.createDataFrame([(t,) for t in terms], "term string"), 4).collect()))
    want = []
    for t in {t.lower() for t in terms if t is not None}:
        hits = [x for x in rows if t in (x[1] or "").lower() or t in (x[4] or "").lower()]
        want += [(t, x[0], k + 1) for k, x in enumerate(sorted(hits, key=lambda x: (-x[2], -x[3], x[0]))[:4])]
    assert got == sorted(want)
    assert [x.id for x in graph.search(nodes, "zAB", 3).collect()] == [i for t, i, k in sorted(want, key=lambda x: x[2]) if t == "zab"][:3]
    plan = traversal.search_terms(nodes, spark.createDataFrame([("ab",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_context_of_several_steps(spark):
    nodes = spark.createDataFrame([(k, f"node {k}", 0.5, 0.5) for k in range(20)], "id long, name string, quality_score double, confidence double")
    edges = spark.createDataFrame([(a, b, "T") for a, b in PATH], "src long, dst long, type string")
    asked = spark.createDataFrame([(1, "NODE 12"), (1, "node 0"), (2, "ode 5"), (3, "x")], "query_id long, name string")
    got = sorted(map(tuple, answering.graph_context(asked, nodes, edges, depth=3).collect()))
    assert got == sorted([(1, k) for k in (9, 10, 11, 12, 0, 1, 2, 3)] + [(2, k) for k in range(2, 9)])


# ---- near duplicates ------------------------------------------------------------------------------
def kept_seqs(rows, threshold=0.8):
    sets = [(s, frozenset((t or "").lower().split())) for s, t in rows]
    later = lambda s: (s is None, s or 0)
    first = {}
    for s, w in sets:
        first[w] = min(first.get(w, s), s, key=later)
    near = lambda a, b: 10 * len(a & b) >= round(10 * threshold) * len(a | b) > 0
    return sorted((s is None, s or 0) for w, s in first.items() if not any(later(first[v]) < later(s) and near(w, v) for v in first if v != w))


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 25))] for _ in range(25)]
    rows = []
    for k in range(260):
        own = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        rows.append((r.choice([k, k, k, None, 7]), " ".join(own) if r.random() > 0.02 else r.choice([None, "", " "])))
    df = spark.createDataFrame([(s, t, "x", {"m": 1}) for s, t in rows], "seq long, instruction string, key string, extra map<string,int>")
    for threshold in (0.8, 0.5):
        got = similarity.dedup_near(df, threshold)
        assert sorted((x.seq is None, x.seq or 0) for x in got.collect()) == kept_seqs(rows, threshold) and got.columns == df.columns


def test_unrelated_rows_of_null_or_equal_seq_stay(spark):
    rows = [(None, "explain the tides of the sea"), (None, "name three large rivers"), (7, "write a short poem"), (7, "sort these numbers now"), (7, "sort these numbers now")]
    got = similarity.dedup_near(spark.createDataFrame(rows, "seq long, instruction string"))
    assert sorted(r.instruction for r in got.collect()) == sorted({t for _, t in rows})


def test_a_large_group_of_near_copies(spark):
    words = [f"common{k}" for k in range(30)]
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.concat_ws(" ", F.lit(" ".join(words)), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("instruction"))
    began = time.time()
    assert [r.seq for r in similarity.dedup_near(rows).collect()] == [0]
    assert time.time() - began < 40


# ---- ROUGE ----------------------------------------------------------------------------------------
def table_rouge(x, y):
    import re

    p, q = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (x, y))
    row = [0] * (len(q) + 1)
    for w in p:
        left = corner = 0
        for k, v in enumerate(q, 1):
            up = row[k]
            row[k] = left = corner + 1 if v == w else max(up, left)
            corner = up
    return 2 * row[-1] / (len(p) + len(q)) if p and q else 0.0


def test_rouge_l_equals_the_table(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 150))) for _ in range(60)] + [None, "", "é ü", "A-b,c"]
    pairs = [(r.choice(texts), r.choice(texts)) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.rouge_l("a", "b").alias("s")).collect()
    assert all(x.s == table_rouge(x.a, x.b) == table_rouge(x.b, x.a) for x in got)


def test_diversity_keeps_every_row(spark):
    rows = spark.createDataFrame([(5, "name a large river", "x"), (5, "name a large river", "x"), (6, "sort the list", None), (None, None, None)], "seq long, instruction string, more string")
    accepted = spark.createDataFrame([(1, "name a large city"), (2, "sort it"), (6, "sort the list")], "seq long, instruction string")
    for by in ("rouge", "jaccard"):
        got = gates.diversity(rows, accepted, by=by).collect()
        assert len(got) == 4 and {r.seq for r in got} == {5, 6, None}
    got = {(r.seq, round(r.similarity, 6)) for r in gates.diversity(rows, accepted, by="rouge").collect()}
    assert got == {(5, 0.75), (6, 0.4), (None, 0.0)}
    assert gates.diversity(rows, accepted.limit(0), by="rouge").where("similarity = 0 and diverse").count() == 4
