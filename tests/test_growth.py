"""What grows with the input is neither broadcast nor held whole in one task."""

import re

import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def broadcast_rows(spark, df):
    """The plan below each broadcast."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    return [x for x in lines if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


@pytest.mark.parametrize("name", ["proximity_in_sentences", "relations_in_sentences", "extract_relations_proximity"])
def test_entities_are_not_broadcast(spark, name):
    assert not broadcast_rows(spark, registry.QUERIES[name](spark, SF))


def test_ngrams_of_names_are_not_broadcast(spark, monkeypatch):
    from tessera.operators import traversal

    for most in (0, 1 << 20):  # terms shuffled, and broadcast
        monkeypatch.setattr(traversal, "TERM_BYTES", most)
        joins = broadcast_rows(spark, registry.QUERIES["search_many_entities"](spark, SF))
        assert all(re.search("BuildRight", x) for x in joins) and len(joins) == (3 if most else 0)


@pytest.mark.parametrize("name", ["chunk_smart_paragraph", "chunk_sentence_500_100", "extract_entities", "document_context", "topics_top10", "render_prompt_generation"])
def test_texts_go_to_python_in_slices(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def test_slices_give_every_row(spark, monkeypatch):
    from tessera.functions import tables

    monkeypatch.setattr(tables, "SLICE", 5)
    rows = [(k, f"s{k}", None if k % 7 == 0 else "ä" * (k % 5) * (1 + k % 3)) for k in range(2500)]
    df = spark.createDataFrame(rows, "k long, s string, text string").coalesce(1)
    got = tables.per_text(df, lambda t: [(i, c) for i, c in enumerate(t or "")], "place int, letter string").collect()
    assert sorted(map(tuple, got)) == sorted((k, s, i, c) for k, s, t in rows for i, c in enumerate(t or ""))
    assert tables.per_text(df.limit(0), lambda t: [(t,)], "x string").count() == 0


def test_every_pair_by_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import retrieval

    monkeypatch.setattr(retrieval, "ROWS", 5)
    monkeypatch.setattr(retrieval, "ASKED", 2)
    rows = [(k, [float(k % 5), 1.0 - k, 2.0]) for k in range(23)] + [(50, None), (51, [1.0, None, 2.0]), (52, [1.0]), (53, []), (54, [0.0] * 3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 5 < 2").selectExpr("vec_id as query_id", "embedding as query")
    df = retrieval.cosine_pairs(v, q)
    assert "NestedLoop" not in df._jdf.queryExecution().sparkPlan().toString()
    of = lambda rows: sorted((r.query_id, r.vec_id, round(r.similarity, 9)) for r in rows if r.vec_id < 50 or r.vec_id == 54)
    want = v.crossJoin(q).select("query_id", "vec_id", retrieval.cosine(F.col("embedding"), F.col("query")).alias("similarity")).collect()
    got = df.collect()
    assert len(got) == len(want) and of(r for r in got if r.query_id < 50) == of(r for r in want if r.query_id < 50)


def test_runs_are_cut_once_for_all_verbs(spark):
    from tessera.operators import graph

    assert all(graph.required_words(verbs, True) for _, verbs in graph.VERBS)
    text = "Ann Bee works for Big Corp. Big Corp WORKſ AT Ann Bee! Ann Bee serves as  president of Big Corp, Big Corp BAſED İN Old City; Ann Bee and Old City"
    names = ["Ann Bee", "Big Corp", "Old City"]
    entities = spark.createDataFrame([(1, n, n, 0, k) for k, n in enumerate(names)], "doc_id long, eid string, name string, pattern int, position int")
    df = graph.pattern_relations(spark.createDataFrame([(1, text)], "doc_id long, text string"), entities, ("name",))
    got = {(r.src_name, r.type, r.dst_name) for r in df.collect()}
    assert got == {("Ann Bee", "WORKS_FOR", "Big Corp"), ("Big Corp", "WORKS_FOR", "Ann Bee"), ("Ann Bee", "LEADS", "Big Corp"), ("Big Corp", "LOCATED_IN", "Old City"), ("Ann Bee", "ASSOCIATED_WITH", "Old City")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum("[^" in x and "Generate explode(split(" in x for x in plan.split("\n")) <= 2  # runs, and pairs by &; eight before
