"""Incremental tables, result envelopes, in-row topics and paragraphs, and required words of patterns."""

import json
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import chunking, graph
from tessera.plans import registry
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = spark.range(60).select((F.col("id") % 20).alias("doc_id"), (F.col("id") / 20).cast("int").alias("chunk_index"), F.lit("old").alias("text"))
    files.write_chunk_index(chunks, path, 8)
    before = _files(path)
    files.replace_documents(spark.createDataFrame([(3, 0, "new")], chunks.schema), path, 8)
    after = _files(path)
    own = spark.read.parquet(path).where("doc_id = 3").select("bucket", "text").collect()
    assert [r.text for r in own] == ["new"] and spark.read.parquet(path).count() == 58
    held = f"bucket={own[0].bucket}/"
    assert {p for p in before if held not in p} == {p for p in after if held not in p} and all(before[p] == t for p, t in after.items() if held not in p)
    files.replace_documents(chunks.limit(0), path, 8)
    assert _files(path) == after


def test_upserts_into_a_table(spark, tmp_path):
    path = str(tmp_path / "nodes")
    one = spark.createDataFrame([(k, "a", 1) for k in range(30)], "id long, name string, updated_at int")
    two = spark.createDataFrame([(3, "b", 2), (4, "c", 0), (99, "d", 1)], one.schema)
    for rows in (one, two, two):
        files.upsert_table(rows, path, ["id"], buckets=5)
    got = {r.id: r.name for r in spark.read.parquet(path).collect()}
    assert len(got) == 31 == spark.read.parquet(path).count() and (got[3], got[4], got[99]) == ("b", "a", "d")


def test_result_envelopes(spark, tmp_path):
    data = {"rows": [{"instruction": "x", "n": 3}], "nested": {"deep": [1, 2.5, None]}}
    (tmp_path / "a.json").write_text(json.dumps({"id": "r1", "title": "T", "type": "alpaca", "data": data, "created_at": "2999-01-01", "workflow_id": "w"}, indent=2))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[1, 2]")
    (tmp_path / "d.json").write_text("{}")
    rows = files.scan_results(spark, str(tmp_path / "*.json"))
    got = {r.id: r for r in rows.drop("data").collect()}
    assert rows.first().id == "r1"
    assert (got["b"].type, got["b"].title, got["b"].description) == ("corrupted", "Corrupted Result b", "File contains invalid JSON")
    assert (got["c"].type, got["c"].title, got["c"].description) == ("unknown", "Result c", "Invalid result format")
    assert (got["d"].type, got["d"].title, got["d"].description) == ("unknown", "Result d", "Workflow result")
    assert got["r1"].file_size == (tmp_path / "a.json").stat().st_size and got["r1"].workflow_id == "w"
    deep = rows.where("id = 'r1'").select(F.variant_get("data", "$.nested.deep[1]", "double").alias("x"), F.variant_get("data", "$.rows[0].n", "int").alias("n")).first()
    assert (deep.x, deep.n) == (2.5, 3) and rows.where("data is not null").count() == 1
    for _ in range(2):  # a second run replaces the first
        files.write_envelopes(rows.where("id = 'r1'"), str(tmp_path / "out"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "full")).collect()]
    assert len(back) == 1 and back[0]["data"] == data and back[0]["title"] == "T"
    assert json.loads(spark.read.text(str(tmp_path / "out" / "data")).first().value)["data"] == data


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        tables.shared_dir(Session())


@pytest.mark.parametrize("name", ["topics_top10", "document_context", "chunk_smart_paragraph"])
def test_nothing_is_shuffled(spark, name):
    assert "Exchange" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_paragraphs(spark):
    texts = [None, "", "  \n\n ", "one", "a" * 600 + "\n\n" + "b" * 600 + "\n \t\n" + "c", "\n\n".join("x" * 999 for _ in range(9)), "a\n\n" + "b" * 5000 + "\n\nc"]
    got = {}
    for r in chunking.paragraph_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, [len(p) for p in r.text.split("\n\n")]))
    assert got == {3: [(0, [3])], 4: [(0, [600, 600]), (1, [1])], 5: [(0, [999, 999]), (1, [999]), (2, [999]), (3, [999]), (4, [999])], 6: [(0, [1, 5000]), (1, [1])]}


def test_required_words_lose_no_match(spark):
    patterns = [("A", 0.5, False, r"(?i)new york"), ("B", 0.5, True, r"\bKelvin (?:Law|Effect)\b"), ("C", 0.5, False, r"(?:ab|cd)?ef+"), ("D", 0.5, False, r"x|yz"), ("E", 0.5, False, r"(?=q)q(?!u)"), ("F", 0.5, True, "straße|ſet"), ("G", 0.5, False, r"(ab|ac){2}d")]
    assert graph.required_words(r"\b[A-Z][a-z]+ (?:City|County)\b") == (" City", " County") and graph.required_words("(?i)new york") == ()
    r = random.Random(8)
    parts = ["New york", "NEW YORK", "kelvin LAW", "Kelvin Effect", "abef", "eff", "x", "yz", "q", "qu", "STRASSE", "Straße", "set", "ſet", "abacd", "acabd", " ", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(300)]
    every = tuple(patterns) + graph.PATTERNS
    got = Counter((x.doc_id, x.pattern, x.position, x.name) for x in graph.extract_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), every).collect())
    want = Counter((d, k, m.start(), m.group().strip()) for d, t in enumerate(texts) for k, (kind, _, ic, p) in enumerate(every) for m in re.compile(p, re.IGNORECASE if ic else 0).finditer(t) if kind != "Person" or (len(m.group().strip()) > 3 and m.group().strip() not in graph.NOT_PERSONS))
    assert got == want and len(got) > 200
