"""Whole values, whole columns, bounded learning and exact ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, labelled, sharding


def _sources_in_a_shard(spark, name):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.format_string(name, F.col("id") % 40).alias("source"), F.lit("en").alias("lang"))
    got = sharding.hilbert_shards(docs, 40, carry=("source",))
    return got.groupBy("shard").agg(F.count_distinct("source").alias("n")).agg(F.avg("n")).first()[0]


def test_a_common_prefix_does_not_blind_a_dimension(spark):
    assert _sources_in_a_shard(spark, "https://site%d.org/x") < 6 and _sources_in_a_shard(spark, "%d") < 6


def test_string_quantiles(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([None] * 5 + ["a"] * 50 + [f"b{x:03d}" for x in range(100)])], "text_key long, v string")
    cuts = sharding._cuts(rows, "v")
    assert len(cuts) == 63 and cuts == sorted(cuts) and cuts.count("a") == 21 and len(set(cuts)) == 43
    assert sharding._cuts(rows.limit(0), "v") == [] and len(sharding._cuts(rows.where("text_key < 7"), "v")) == 63


def test_written_shards_keep_every_column(spark, tmp_path):
    names = ["rank", "size", "run", "start", "total", "shard", "slot", "_slot", "hilbert", "text_key", "n"]
    docs = spark.createDataFrame([(k, f"t{k}", "s", "en", *[f"{n}{k}" for n in names]) for k in range(30)], ["doc_id", "text", "source", "lang", *names])
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "_shard", "__slot", "_hilbert"}
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))


def test_learning_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, chr(97 + k % 26) * 1000) for k in range(200)] + [(1, "z")] * 50 + [(None, "x")], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    sizes = []

    def learn(texts, ys):
        assert len(texts) == len(ys)
        return repr((len(texts), sum(map(len, texts)))).encode()

    for total in (0, 10_000, 10**9):
        sizes.append(eval(labelled.fit(docs, labels, "quality", 100, learn, total_bytes=total)))
    assert sizes[0] == (0, 0) and 0 < sizes[1][1] <= 10_000 and sizes[2][0] == 100


def _nearest(rows, query, k=5):
    best = sorted((-np.float64((np.array(v) * query).sum() / (np.linalg.norm(v) * np.linalg.norm(query))), i) for i, v in rows)
    return [i for _, i in best[:k]]


def test_ties_of_equal_directions_go_to_the_smaller_id():
    r = np.random.default_rng(4)
    directions = r.standard_normal((8, ann.DIMENSIONS))
    wrong = 0
    for turn in range(30):
        ids = r.permutation(400)[:120]
        vectors = r.standard_normal((120, 8))
        vectors[:20] = np.array([3.0, 4.0] + [0.0] * 6) * np.arange(1, 21)[:, None]
        index = ann.Index(ids, vectors, directions, 6)
        query = np.array([3.0, 4.0] + [0.0] * 6)
        got = [i for _, i, _ in index.search(np.array([-1]), query[None], np.array([np.inf]), 5)]
        exact = (vectors[:20] * query).sum(axis=1) / (np.linalg.norm(vectors[:20], axis=1) * 5)
        wrong += got != [int(i) for _, i in sorted(zip(-exact, ids[:20]))[:5]]
    assert wrong == 0


def test_ties_over_several_regions(spark, monkeypatch):
    monkeypatch.setattr(ann, "REGION", 16)
    r = np.random.default_rng(5)
    rows = [(int(k), r.standard_normal(6).tolist()) for k in range(1, 300)] + [(0, [3.0, 4.0, 0.0, 0.0, 0.0, 0.0])] + [(1000 + k, [3.0 * (20 - k), 4.0 * (20 - k), 0.0, 0.0, 0.0, 0.0]) for k in range(20)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5)
    assert [x.vec_id for x in got.where("query_id = 0").orderBy("rank").collect()] == _nearest([x for x in rows if x[0]], np.array([3.0, 4, 0, 0, 0, 0]))


@pytest.mark.parametrize("rows", [500, 2000])
def test_recall_over_many_regions(spark, monkeypatch, rows):
    monkeypatch.setattr(ann, "REGION", 32)
    r = np.random.default_rng(rows)
    centres = r.standard_normal((12, 16)) * 2
    vectors = {k: (centres[k % 12] + r.standard_normal(16)).tolist() for k in range(rows)}
    got = {}
    for x in ann.nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), every=50, k=5).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    want = {q: set(_nearest([x for x in vectors.items() if x[0] != q], np.array(vectors[q]))) for q in vectors if q % 50 == 0}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)


def test_cuts_part_one_group_of_copies_each(spark):
    texts = [f"text {k % 37}" for k in range(900)] + ["hot"] * 500
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = sharding.hilbert_shards(docs, 40, carry=("text",))
    apart = got.groupBy("text").agg((F.count_distinct("shard") - 1).alias("cuts")).agg(F.sum("cuts")).first()[0]
    assert 0 < apart <= 39
