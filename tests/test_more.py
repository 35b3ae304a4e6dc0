"""Tests of parsed items, near duplicates, merges, answers, sinks and the gate on a stream."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import answering, chunking, evaluation, gates, graph, parsing, retrieval, similarity
from tessera.sources import files
from tessera.streaming import monitoring


def test_eight_responses(spark):
    good = '{"a": 1}'
    cases = {
        "clean": good,
        "fenced": f"```json\n{good}\n```",
        "extra": f"Here is the JSON: {good} Hope this helps!",
        "malformed": '{"a": 1, "b": [1, 2}',
        "conversational": f"Sure, I would say\n{good}\nis what you want",
        "several": '{"invalid": true} and {"a": 1}',
        "empty": "",
        "none": "no JSON here",
        "late": "[" * 2000 + " x " + good,
        "deep": "[" * 20_000,
    }
    got = {r.case: r.json for r in parsing.extract_json(spark.createDataFrame([*cases.items(), ("null", None)], "case string, response string")).collect()}
    for case in ("clean", "fenced", "extra", "conversational", "late"):
        assert got[case] == good, case
    assert got["several"] == '{"invalid": true}' and all(got[c] is None for c in ("empty", "none", "deep", "null"))


def test_valid_and_exploded_items(spark):
    rows = [
        ("ok", '[{"name":"n","definition":"d","domain":"x","confidence":"low","examples":["e"]}]'),
        ("text", '[{"name":"n","definition":"d","domain":"x","confidence":"low","examples":"e"}]'),
        ("missing", '[{"name":"n","definition":"d"}]'),
        ("none", "[]"),
        ("bad", "no"),
        ("null", None),
    ]
    df = spark.createDataFrame(rows, "case string, json string")
    assert {r.case: r.v for r in df.select("case", parsing.valid_concepts(F.col("json")).alias("v")).collect()} == {"ok": True, "text": False, "missing": False, "none": True, "bad": False, "null": False}
    out = {r.case: r for r in parsing.explode_concepts(df).collect()}
    assert out["ok"].examples == ["e"] and out["missing"].confidence == "medium" and out["missing"].relationships == []
    many = spark.createDataFrame([(1, "[" + ",".join('{"content":"c%d"}' % k for k in range(7)) + "]")], "id int, json string")
    facts = parsing.explode_facts(many).collect()
    assert [(r.pos, r.content, r.fact_type, r.confidence) for r in facts] == [(k, f"c{k}", "general", "0.5") for k in range(5)]


def test_dedup_near_against_brute_force(spark):
    base = "list the main causes of the long war in the north and say which of them mattered most for trade".split()
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base[:-1] + ["peace"]), " ".join(base[:9]), "", None, "  ", "one", " ".join(base[::-1])]
    rows = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "seq long, instruction string, w string")
    sets = [set((t or "").lower().split()) for t in texts]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0
    want = [k for k, s in enumerate(sets) if not any(near(s, sets[j]) for j in range(k))]
    got = similarity.dedup_near(rows)
    assert sorted(r.seq for r in got.collect()) == want and got.columns == rows.columns
    assert similarity.dedup_near(rows.limit(0)).count() == 0


def test_merges_are_idempotent(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    old = spark.createDataFrame([("a", "b", "T", 0.1, 1), ("a", "x", "T", 0.5, 1)], "src string, dst string, type string, strength double, updated_at int")
    new = spark.createDataFrame([("a", "b", "T", 0.9, 2), ("b", "a", "T", 0.3, 2)], old.schema)
    once = graph.upsert_edges(old, new, nodes)
    assert sorted(tuple(r) for r in once.collect()) == [("a", "b", "T", 0.9, 2), ("b", "a", "T", 0.3, 2)]
    assert sorted(tuple(r) for r in graph.upsert_edges(once, new, nodes).collect()) == sorted(tuple(r) for r in once.collect())


def test_cleaning_of_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(chunking.strip_reasoning_tags(F.lit("<think>a\nb</think>Yes<Analysis>z</Analysis>."))) == "Yes."
    assert "{" in one(chunking.strip_reasoning_preamble(F.lit('Okay, let me see. {"a": 1}')))
    assert one(chunking.clean_answer(F.lit("<think>x</think>Plain answer."))).strip() == "Plain answer."


def test_answers_with_and_without_a_graph(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    asked = spark.createDataFrame([(1, "Ann")], "query_id long, name string")
    nodes = spark.createDataFrame([("n1", "ann lee", 0.8, 0.5), ("n2", "Bob", 0.4, 0.5)], "id string, name string, confidence double, quality_score double")
    edges = spark.createDataFrame([("n1", "n2", "KNOWS")], "src string, dst string, type string")
    none = spark.createDataFrame([], "query_id long, similarity double")
    answers = spark.createDataFrame([(1, "w " * 50)], "query_id long, answer string")
    got = {r.query_id: r for r in answering.graph_rag_query(q, asked, nodes, edges, none, answers).collect()}
    assert got[1].entities == 2 and got[1].relations == 1 and abs(got[1].avg_confidence - 0.6) < 1e-9
    assert got[2].entities == 0 and got[2].reasoning_path == ["Limited context available - answer may be incomplete"]


def test_concept_and_pair_points(spark):
    row = spark.createDataFrame([("name", "d" * 60, ["one", "two"], ["rel"], 1.0)], "n string, d string, e array<string>, r array<string>, c double")
    got = row.select(evaluation.concept_points_v3(F.col("n"), F.col("d"), F.col("e"), F.col("r"), F.col("c")).alias("x")).first().x
    assert got == 6.0
    pair = spark.range(1).select(evaluation.qa_points_v3(F.lit("Compare the two plans."), F.lit("word " * 30)).alias("x")).first().x
    assert pair == 4.0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "a", "type": "text_generation"}\n{"name": "b", "type": "embedding"}\n')
    assert [r.name for r in files.scan_model_registry(spark, str(tmp_path / "m.json")).collect()] == ["a"]
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01"), (3, None)], "id int, upload_time string")
    assert [r.id for r in files.newest_first(rows).collect()] == [2, 1, 3]
    files.write_envelopes(spark.createDataFrame([("r", "t", "x")], "id string, title string, data string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "data")).first().data == "x"
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    assert [r.doc_id for r in retrieval.delete_index(chunks, chunks.where("doc_id = 1")).collect()] == [2] and retrieval.delete_index(chunks).count() == 0


def test_gate_on_a_stream_equals_gate_on_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("Explain the plan well.", "", "It is a good plan."), ("x", "", "")], "instruction string, input string, output string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        monitoring.stream_quality_gate(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.instruction, r.accepted) for r in gates.gate(rows).collect()}
    assert {(r.instruction, r.accepted) for r in got.collect()} == want and got.count() == 2


@pytest.mark.parametrize("seconds", [0, 90])
def test_run_statistics(spark, seconds):
    rows = spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' AS started_at, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,{seconds}) AS ended_at")
    r = gates.run_statistics(rows, 4).first()
    assert (r.generated, r.completion_rate, r.seconds) == (1, 0.25, seconds)


def test_pattern_table_is_bounded_and_ordered(spark):
    rows = spark.createDataFrame([("B", None, None, "x+"), ("A", 0.9, True, "y"), (None, 0.1, True, "z"), ("C", 0.1, True, None)], "type string, confidence double, ignore_case boolean, pattern string")
    made = graph.pattern_table(rows)
    assert made == (("A", 0.9, True, "y"), ("B", 0.5, False, "x+"))
    docs = spark.createDataFrame([(1, "xx Y"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.name, r.type) for r in graph.extract_entities(docs, made).collect()} == {(1, "xx", "B"), (1, "Y", "A")}
    with pytest.raises(ValueError):
        graph.pattern_table(rows, most=1)


def test_append_log_of_tables_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 11, "b")], "event_id long, ts long, what string")
    path = str(tmp_path / "log")
    monitoring.append_log(rows.where("event_id = 1"), path)
    rows.where("event_id = 2").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        monitoring.append_log(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "seen"))
    assert sorted((r.event_id, r.what, str(r.batch)) for r in spark.read.parquet(path).collect()) == [(1, "a", "table"), (2, "b", "0")]


def test_model_recommendations(spark):
    scored = spark.createDataFrame([("t", 1, "ollama:gemma3:27b", 0.9), ("t", 2, "ollama:llama2:13b", 0.2), ("u", 1, "other", 0.1)], "task string, position int, model string, score double")
    got = {r.task: r for r in evaluation.model_recommendations(scored).collect()}
    assert (got["t"].performance, got["t"].speed, got["t"].models) == ("ollama:gemma3:27b", "ollama:llama2:13b", 2)
    assert got["u"].balanced == got["u"].quality == "other"


def test_embed_batch_fails_by_row(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0, float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "ccc")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.embedding, r.error) for r in retrieval.embed_batch(rows, model, 2).collect()}
    assert got == {1: ([1.0, 1.0], None), 2: ([0.0, 0.0], "no"), 3: ([1.0, 3.0], None)}
