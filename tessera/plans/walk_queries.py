"""Queries of walks over a larger graph, many terms at once, relations in written sentences, sliding ratings, indexes and cleaned texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import chunking, graph, traversal
from tessera.plans.graph_queries import WITH, nodes
from tessera.plans.monitor_queries import events
from tessera.plans.registry import query, table
from tessera.plans.text_queries import chunk_sql
from tessera.sources import files
from tessera.streaming import monitoring

# ---- a graph of customers, orders and suppliers ---------------------------------------------------
BOUGHT = """
SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'ORDERED' AS type FROM orders
UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'HOLDS' FROM lineitem WHERE l_linenumber = 1"""
NEAR = f"""RECURSIVE edges AS ({BOUGHT}), b AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
w(id, hops) AS (SELECT 'c1', 0 UNION SELECT dst, hops + 1 FROM w JOIN b ON src = id WHERE hops < {{depth}}), near AS (SELECT id, min(hops) AS hops FROM w GROUP BY id)"""


def bought(spark: SparkSession, d: str) -> DataFrame:
    for name in ("orders", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(BOUGHT)


def _customer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c1",)], "id string")


@query(sql=f"WITH {NEAR.format(depth=6)} SELECT id, CAST(hops AS INTEGER) AS hops FROM near")
def k_hop_six_steps(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(bought(spark, d), _customer(spark), 6)


@query(sql=f"WITH {NEAR.format(depth=3)}, k AS (SELECT id FROM near ORDER BY hops, id LIMIT 1000) SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def k_hop_edges(spark: SparkSession, d: str) -> DataFrame:
    own = bought(spark, d)
    every = own.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return traversal.neighborhood(every, own, _customer(spark), 3, 1000)[1]


@query(sql=f"{WITH}, q AS (SELECT DISTINCT lower(n_name) AS term FROM nation UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT substr(lower(c_mktsegment), 1, 2) FROM customer UNION SELECT lower(c_mktsegment) || ' ' || (c_custkey % 30) FROM customer), a AS (SELECT *, CASE WHEN type = 'Person' THEN '{{\"place\": \"Nation_' || (mentions * 3) || '\"}}' END AS attributes FROM nodes) SELECT term, id, CAST(r AS INTEGER) AS rank FROM (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY quality_score DESC, confidence DESC, id) AS r FROM q JOIN a ON contains(lower(name), term) OR contains(coalesce(lower(attributes), ''), term)) AS x WHERE r <= 10")
def search_many_entities(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("type") == "Person", F.concat(F.lit('{"place": "Nation_'), (F.col("mentions") * 3).cast("string"), F.lit('"}')))
    people, part = table(spark, d, "customer"), table(spark, d, "part")
    terms = [table(spark, d, "nation").select(F.col("n_name").alias("term")), part.select("p_type"), people.select(F.substring("c_mktsegment", 1, 2)), people.select(F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 30).cast("string")))]
    every = terms[0]
    for t in terms[1:]:
        every = every.union(t)
    return traversal.search_terms(nodes(spark, d).withColumn("attributes", place), every, 10)


# ---- relations in sentences about customers --------------------------------------------------------
_letters = lambda c: f"translate(CAST({c} AS STRING), '0123456789', 'abcdefghij')"
SAID = f"SELECT c_custkey AS doc_id, 'Anna K' || {_letters('c_custkey')} AS person, 'Q' || {_letters('c_nationkey')} || ' Corp' AS firm, 'Z' || {_letters('c_custkey % 50')} || ' City' AS town FROM customer"
TEXT = "person || ' works for ' || firm || '. ' || firm || ' owns ' || town || '! so ' || person || ' and ' || firm || ', ' || repeat('so far ', CAST(doc_id % 30 AS INT)) || '(' || town || ').'"
SAID_SQL = f"s AS (SELECT *, {TEXT} AS text FROM ({SAID.replace('STRING', 'VARCHAR')}) AS x)"


def said(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(documents, their entities with an id)."""
    table(spark, d, "customer").createOrReplaceTempView("customer")
    docs = spark.sql(f"SELECT doc_id, {TEXT} AS text FROM ({SAID})")
    found = graph.dedupe_entities(graph.extract_entities(docs))
    return docs, found.withColumn("eid", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lower("name"), "type"), 256))


def _named(found: DataFrame, *columns: str) -> DataFrame:
    """Relations by the names and types that they carry."""
    return found.select("doc_id", F.col("src_name").alias("src"), "src_type", F.col("type").alias("relation"), F.col("dst_name").alias("dst"), "dst_type", *columns)


@query(sql=f"WITH {SAID_SQL} SELECT doc_id, person AS src, 'Person' AS src_type, 'WORKS_FOR' AS relation, firm AS dst, 'Organization' AS dst_type FROM s UNION ALL SELECT doc_id, firm, 'Organization', 'OWNS', town, 'Place' FROM s")
def relations_in_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs, own = said(spark, d)
    return _named(graph.pattern_relations(docs, own, ("name", "type")))


@query(
    sql=f"""WITH {SAID_SQL}, e AS (SELECT doc_id, name, type, strpos(text, name) - 1 AS pos, sha256(doc_id || '|' || lower(name) || '|' || type) AS id FROM (
  SELECT doc_id, text, unnest([person, firm, firm, town, town]) AS name, unnest(['Person', 'Person', 'Organization', 'Person', 'Place']) AS type FROM s) AS u)
SELECT a.doc_id, a.name AS src, a.type AS src_type, 'CO_OCCURS' AS relation, b.name AS dst, b.type AS dst_type, CAST(b.pos - a.pos AS INTEGER) AS distance FROM e AS a JOIN e AS b USING (doc_id)
WHERE b.pos - a.pos BETWEEN 0 AND 99 AND (b.pos > a.pos OR a.id < b.id)"""
)
def proximity_in_sentences(spark: SparkSession, d: str) -> DataFrame:
    _, own = said(spark, d)
    return _named(graph.proximity(own, carry=("name", "type")), "distance")


# ---- ratings in sliding windows ----------------------------------------------------------------------
SLIDING = "w AS (SELECT start, count(*) AS n, avg(value) AS average, count(*) >= 100 AND avg(value) < 50 AS retrain FROM (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start, value FROM events, range(7) AS r(k)) AS e GROUP BY start)"


@query(sql=f"WITH {SLIDING} SELECT start, n, round(average, 6) AS average, retrain FROM w")
def feedback_retrain_sliding(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.windowed_rating(events(spark, d), below=50.0, slide=1).withColumn("average", F.round("average", 6))


@query(sql=f"WITH {SLIDING} SELECT start, event_id, value FROM w JOIN events ON ts >= start AND ts < start + INTERVAL 7 DAY WHERE retrain AND value < 50")
def feedback_low_rated(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d)
    return monitoring.low_rated(own, monitoring.windowed_rating(own, below=50.0, slide=1), below=50.0, slide=1)


# ---- sinks and cleaners --------------------------------------------------------------------------------
@query(sql=f"SELECT doc_id, chunk_index, start_char, text FROM ({chunk_sql(1000, 200)}) AS c")
def sink_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """The index after half of the documents were put in and then all of them, in place."""
    path = tables.shared_dir(spark)
    own = chunking.sentence_chunks(table(spark, d, "documents"))
    files.replace_documents(own.where("doc_id % 2 = 0"), path)
    files.replace_documents(own, path)
    return spark.read.parquet(path).select("doc_id", "chunk_index", "start_char", "text")


THOUGHT = "'<Think>' || text || chr(10) || 'x</think>' || source || '<analysis>' || lang || '</ANALYSIS>.'"


@query(sql="SELECT doc_id, source || '.' AS answer FROM documents")
def strip_reasoning_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunking.strip_reasoning_tags(F.expr(THOUGHT)).alias("answer"))


@query(sql=r"SELECT doc_id, '[' || regexp_replace(text, '[\[{].*', '', 's') || ']' AS answer FROM documents")
def strip_reasoning_preamble(spark: SparkSession, d: str) -> DataFrame:
    own = F.expr(r"'  Okay, so ' || regexp_replace(source, '[\\[{]', '') || ' [' || regexp_replace(text, '(?s)[\\[{].*', '') || ']'")
    return table(spark, d, "documents").select("doc_id", chunking.strip_reasoning_preamble(own).alias("answer"))


@query(sql="SELECT doc_id, '{\"text\": \"' || source || '\"}' AS answer FROM documents")
def strip_response_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit('Here is the JSON: {"text": "'), "source", F.lit('"} Hope this helps.'))
    return table(spark, d, "documents").select("doc_id", chunking.strip_boilerplate(own).alias("answer"))


@query(sql="SELECT doc_id, lang || ' one' || chr(10) || source || ' two' AS answer FROM documents")
def clean_answer(spark: SparkSession, d: str) -> DataFrame:
    own = F.expr("'<think>' || text || '</think>- ' || lang || ' one' || chr(10) || '* ' || source || ' two'")
    return table(spark, d, "documents").select("doc_id", chunking.clean_answer(own).alias("answer"))
