"""Queries of the knowledge graph, retrieval, and model evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answering, evaluation, gates, graph, parsing, retrieval, similarity
from tessera.operators.chunking import sentence_chunks
from tessera.plans.registry import query, table
from tessera.plans.text_queries import INSTR, LCS, N_WORDS, WORDS, chunk_sql, instructions

# ---- a graph of customers, suppliers and nations ------------------------------------------------
NODES = """
SELECT 'c' || c_custkey AS id, c_mktsegment || ' ' || (c_custkey % 400) AS name, 'Person' AS type, (c_custkey % 10) / 10.0 AS confidence, CAST(c_custkey % 7 + 1 AS BIGINT) AS mentions, (c_custkey % 101) / 100.0 AS quality_score FROM customer
UNION ALL SELECT 's' || s_suppkey, s_name, 'Organization', (s_suppkey % 10) / 10.0, CAST(s_suppkey % 7 + 1 AS BIGINT), (s_suppkey % 101) / 100.0 FROM supplier
UNION ALL SELECT 'n' || n_nationkey, n_name, 'Place', 0.9, CAST(3 AS BIGINT), 0.5 FROM nation"""
EDGES = """
SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'LOCATED_IN' AS type, (c_custkey % 10) / 10.0 AS strength, (c_custkey % 101) / 100.0 AS quality_score FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', (s_suppkey % 10) / 10.0, (s_suppkey % 101) / 100.0 FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1), 'NEXT_TO', 0.5, 0.5 FROM nation WHERE n_nationkey % 3 = 0"""
WITH = f"WITH nodes AS ({NODES}), edges AS ({EDGES})"


def _views(spark: SparkSession, d: str, sql: str) -> DataFrame:
    for own in ("customer", "supplier", "nation"):
        table(spark, d, own).createOrReplaceTempView(own)
    return spark.sql(sql.replace("10.0", "10.0D").replace("101) / 100.0", "101) / 100.0D").replace(" 0.9,", " 0.9D,").replace(" 0.5 FROM", " 0.5D FROM").replace(" 0.5,", " 0.5D,"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d, NODES)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d, EDGES)


@query(sql=WITH + " SELECT id, name, quality_score, mentions FROM nodes WHERE type = 'Person' ORDER BY quality_score DESC, mentions DESC, id LIMIT 50")
def entities_by_type(spark: SparkSession, d: str) -> DataFrame:
    return graph.by_type(nodes(spark, d), "Person").select("id", "name", "quality_score", "mentions")


@query(sql=WITH + " SELECT id, name, confidence FROM nodes WHERE contains(lower(name), 'machinery 1') ORDER BY quality_score DESC, confidence DESC, id LIMIT 20")
def search_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(nodes(spark, d), "MACHINERY 1").select("id", "name", "confidence")


@query(sql=WITH + ", b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'n3' AND dst <> 'n3'), h2 AS (SELECT DISTINCT dst AS id FROM b JOIN h1 ON src = id WHERE dst <> 'n3' AND dst NOT IN (SELECT id FROM h1)) SELECT 'n3' AS id, 0 AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2")
def k_hop_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(edges(spark, d), nodes(spark, d).where("id = 'n3'"), 2)


@query(sql=WITH + " SELECT 'node' AS kind, coalesce(type, 'total') AS name, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', coalesce(type, 'total'), count(*) FROM edges GROUP BY ROLLUP (type)")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.statistics(nodes(spark, d), edges(spark, d))


@query(sql=WITH + ", n AS (SELECT count(*) AS nodes, avg(quality_score) AS avg_quality, min(quality_score) AS min_quality, max(quality_score) AS max_quality, avg(confidence) AS avg_confidence FROM nodes), e AS (SELECT count(*) AS edges FROM edges) SELECT nodes, edges, avg_quality, min_quality, max_quality, avg_confidence, 2 * edges / (nodes * (nodes - 1)) AS density FROM n, e")
def graph_quality_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return graph.quality_summary(nodes(spark, d), edges(spark, d))


VISUAL = "v AS (SELECT id, name, type, least(50, greatest(10, mentions * 5)) AS size, CASE type WHEN 'Person' THEN '#FF6B6B' WHEN 'Place' THEN '#4ECDC4' ELSE '#DDA0DD' END AS color FROM nodes ORDER BY quality_score DESC, mentions DESC, id LIMIT 100)"


@query(sql=f"{WITH}, {VISUAL} SELECT * FROM v")
def graph_visual_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.visual_nodes(nodes(spark, d))


@query(sql=WITH + " SELECT src, dst, CASE WHEN quality_score >= 0.8 THEN '#27AE60' WHEN quality_score >= 0.6 THEN '#F39C12' WHEN quality_score >= 0.4 THEN '#E67E22' ELSE '#E74C3C' END AS color FROM edges WHERE src IN (SELECT id FROM nodes WHERE quality_score >= 0.5) AND dst IN (SELECT id FROM nodes WHERE quality_score >= 0.5)")
def graph_visual_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.visual_edges(edges(spark, d), nodes(spark, d).where("quality_score >= 0.5")).select("src", "dst", "color")


DUPLICATES = "k AS (SELECT lower(name) AS k, type, arg_min(id, (-mentions, id)) AS top FROM nodes GROUP BY 1, 2 HAVING count(*) > 1), pairs AS (SELECT top AS \"primary\", id AS duplicate FROM nodes JOIN k ON lower(name) = k AND nodes.type = k.type WHERE id <> top)"


@query(sql=f"{WITH}, {DUPLICATES} SELECT * FROM pairs")
def find_duplicate_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_duplicates(nodes(spark, d))


@query(sql=f"{WITH}, {DUPLICATES}, x AS (SELECT \"primary\" AS id, sum(mentions) AS more FROM pairs JOIN nodes ON id = duplicate GROUP BY 1) SELECT id, CAST(mentions + coalesce(more, 0) AS BIGINT) AS mentions FROM nodes LEFT JOIN x USING (id) WHERE id NOT IN (SELECT duplicate FROM pairs)")
def merge_duplicate_entities(spark: SparkSession, d: str) -> DataFrame:
    own = nodes(spark, d)
    return graph.merge_duplicates(own, edges(spark, d), graph.find_duplicates(own))[0].select("id", "mentions")


@query(sql=f"{WITH}, {DUPLICATES}, m AS (SELECT coalesce(p.\"primary\", src) AS src, dst, p.\"primary\" IS NOT NULL AS moved FROM edges LEFT JOIN pairs AS p ON src = duplicate) SELECT src, dst, 'edge' AS kind FROM m WHERE NOT moved UNION ALL SELECT DISTINCT src, dst, 'moved' FROM m WHERE moved AND NOT EXISTS (SELECT 1 FROM m AS o WHERE NOT o.moved AND o.src = m.src AND o.dst = m.dst)")
def merge_duplicate_edges(spark: SparkSession, d: str) -> DataFrame:
    own = nodes(spark, d)
    merged = graph.merge_duplicates(own, edges(spark, d), graph.find_duplicates(own))[1]
    return merged.select("src", "dst", F.when(F.col("type") == "RELATED_TO", "moved").otherwise("edge").alias("kind"))


@query(sql=WITH + " SELECT src, dst, type FROM edges WHERE strength >= 0.4 AND src IN (SELECT id FROM nodes WHERE confidence >= 0.5) AND dst IN (SELECT id FROM nodes WHERE confidence >= 0.5)")
def remove_low_quality_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.remove_low_quality(nodes(spark, d), edges(spark, d))[1].select("src", "dst", "type")


@query(sql="SELECT o_custkey AS src, o_orderpriority AS dst, 'ORDERED' AS type, round(1 - exp(sum(ln(1 - (o_orderkey % 9) / 10.0))), 6) AS strength, count(*) AS evidence FROM orders GROUP BY 1, 2")
def strengthen_relationships(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.lit("ORDERED").alias("type"), (F.col("o_orderkey") % 9 / 10).alias("strength"))
    return graph.strengthen(own).withColumn("strength", F.round("strength", 6))


@query(sql=WITH + " SELECT id, CASE WHEN type = 'Place' THEN 0.75 ELSE quality_score END AS quality_score FROM nodes")
def update_entity_quality(spark: SparkSession, d: str) -> DataFrame:
    own = nodes(spark, d)
    return graph.update_quality(own, own.where("type = 'Place'").select("id", F.lit(0.75).alias("score"))).select("id", "quality_score")


@query(sql="SELECT user_id AS id, arg_max(value, (ts, value)) AS value, max(ts) AS updated_at FROM events GROUP BY user_id")
def graph_upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select(F.col("user_id").alias("id"), "value", F.col("ts").alias("updated_at"))
    return graph.upsert(own.where("value < 50"), own.where("value >= 50"), ["id"])


@query(sql=WITH + " SELECT src, dst, type FROM edges WHERE dst IN (SELECT id FROM nodes WHERE type = 'Place') AND src IN (SELECT id FROM nodes WHERE confidence > 0.2)")
def graph_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    own = nodes(spark, d)
    return graph.with_ends(edges(spark, d), own.where("type = 'Place' OR confidence > 0.2")).join(own.where("confidence > 0.2").select(F.col("id").alias("src")), "src", "left_semi").join(own.where("type = 'Place'").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type")


@query(sql=WITH + " SELECT (SELECT count(DISTINCT id) FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) AS x) / (SELECT count(*) FROM nodes) AS coverage")
def relationship_coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationship_coverage(edges(spark, d), nodes(spark, d))


# ---- entities in documents ----------------------------------------------------------------------
def entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.extract_entities(table(spark, d, "documents"))


@query()
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d)


@query()
def dedupe_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.dedupe_entities(entities(spark, d))


@query()
def extract_relations_proximity(spark: SparkSession, d: str) -> DataFrame:
    own = graph.dedupe_entities(entities(spark, d)).withColumn("eid", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lower("name"), "type"), 256))
    return graph.proximity(own)


@query()
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_coverage(entities(spark, d), table(spark, d, "documents"))


# ---- retrieval ----------------------------------------------------------------------------------
NORM = "sqrt(list_sum(list_transform({0}, lambda x : CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i : CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))"


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(sql=f"SELECT query_id, vec_id, round({DOT} / ({NORM.format('a')} * {NORM.format('b')}), 9) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 50 = 0) AS p")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    return retrieval.cosine_pairs(own, _queries(own)).withColumn("similarity", F.round("similarity", 9))


@query(sql=f"SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(s, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM (SELECT query_id, vec_id, {DOT} / ({NORM.format('a')} * {NORM.format('b')}) AS s FROM (SELECT q.vec_id AS query_id, e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 50 = 0) AS p) AS t) AS u WHERE r <= 5")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    return retrieval.knn(own, _queries(own), 5).withColumn("similarity", F.round("similarity", 9))


@query(sql="SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM (SELECT query_id, vec_id, 1 - list_sum(list_transform(range(1, len(a) + 1), lambda i : pow(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE), 2))) AS s FROM (SELECT q.vec_id AS query_id, e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 50 = 0) AS p) AS t) AS u WHERE r <= 5")
def knn_distance(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    return retrieval.knn(own, _queries(own), 5, "distance").withColumn("similarity", F.round("similarity", 6))


@query()
def knn_approx(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    return retrieval.knn_approx(own, _queries(own))


@query(sql=f"WITH p AS (SELECT item_id AS query_id, doc_id AS rank, list_distinct({WORDS.format('lower(b.text)')}) AS q, list_distinct({WORDS.format('lower(d.text)')}) AS t FROM benchmark AS b JOIN documents AS d ON d.doc_id % 40 = b.item_id) SELECT query_id, rank, round(o, 9) AS overlap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o DESC, rank) AS INTEGER) AS new_rank FROM (SELECT query_id, rank, len(list_intersect(q, t)) / greatest(len(q), 1) AS o FROM p) AS x")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    own = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("rank"), "text")
    return retrieval.rerank_overlap(own.join(q, "query_id")).select("query_id", "rank", F.round("overlap", 9).alias("overlap"), "new_rank")


@query(sql=f"SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM ({chunk_sql(1000, 200)}) AS c")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return sentence_chunks(table(spark, d, "documents")).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


# ---- evaluation: users are models, event types are tasks, values are scores ----------------------
SCORES = "scores AS (SELECT 'm' || user_id AS model, event_type AS task, value / 100 AS score, ts FROM events), latest AS (SELECT model, task, arg_max(score, (ts, score)) AS score, count(*) AS evaluations FROM scores GROUP BY model, task)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"), F.col("event_type").alias("task"), (F.col("value") / 100).alias("score"), "ts")


@query(sql=f"WITH {SCORES} SELECT model, avg(score) AS overall_score, count(*) AS tasks, CAST(sum(evaluations) AS BIGINT) AS evaluations FROM latest GROUP BY model")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.registry(scores(spark, d))


@query(sql=f"WITH {SCORES}, o AS (SELECT model, avg(score) AS s FROM latest GROUP BY model), w AS (SELECT 'm' || c_custkey AS model, t AS task FROM customer, (VALUES ('click'), ('none')) AS v(t)) SELECT model, task, coalesce(score, s, 0.5) AS score FROM w LEFT JOIN latest USING (model, task) LEFT JOIN o USING (model)")
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("model"), F.explode(F.array(F.lit("click"), F.lit("none"))).alias("task"))
    own = scores(spark, d)
    return evaluation.registry_lookup(wanted, evaluation.latest_scores(own), evaluation.registry(own))


BOARD = f"WITH {SCORES}, g AS (SELECT model, task FROM (SELECT DISTINCT model FROM scores) AS m, (SELECT DISTINCT task FROM scores) AS t), board AS (SELECT model, sum(coalesce(score, 0)) AS total, count(*) * 1.0 AS possible FROM g LEFT JOIN latest USING (model, task) GROUP BY model)"


def board(spark: SparkSession, d: str) -> DataFrame:
    own = scores(spark, d)
    return evaluation.scoreboard(own.select("model").distinct(), own.select("task").distinct(), own, 1.0).withColumn("total", F.round("total", 9))


@query(sql=f"{BOARD} SELECT model, round(total, 9) AS total, CAST(possible AS DOUBLE) AS possible, round(total / possible * 100, 6) AS percent FROM board")
def model_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    return board(spark, d).withColumn("percent", F.round("percent", 6))


@query(sql=f"{BOARD} SELECT model, round(total, 9) AS total, CAST(row_number() OVER (ORDER BY round(total, 9) DESC, model) AS INTEGER) AS rank FROM board")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ranking(board(spark, d)).select("model", "total", "rank")


@query(sql=f"WITH {SCORES} SELECT task, arg_min(model, (-score, model)) AS best_model, max(score) AS best_score, arg_min(model, (score, model)) AS worst_model, min(score) AS worst_score, avg(score) AS average FROM latest GROUP BY task")
def task_performance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.task_performance(evaluation.latest_scores(scores(spark, d)))


@query(sql=f"WITH {SCORES} SELECT task, count(DISTINCT model) AS models_evaluated, count(DISTINCT model) / (SELECT count(*) FROM customer) * 100 AS coverage_percent FROM latest GROUP BY task")
def performance_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.performance_summary(evaluation.latest_scores(scores(spark, d)), table(spark, d, "customer").select(F.col("c_custkey").alias("model")))


@query(sql=f"WITH {SCORES} SELECT model, round(sum(w * score) / sum(w), 9) AS weighted FROM (SELECT model, score, CASE task WHEN 'click' THEN 1.2 ELSE 1.0 END AS w FROM latest) AS l GROUP BY model")
def weighted_task_score(spark: SparkSession, d: str) -> DataFrame:
    weights = scores(spark, d).select("task").distinct().select("task", F.when(F.col("task") == "click", 1.2).otherwise(1.0).alias("weight"))
    return evaluation.weighted_score(evaluation.latest_scores(scores(spark, d)), weights).withColumn("weighted", F.round("weighted", 9))


NAMED = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'ollama:llama2:13b' WHEN 1 THEN 'ollama:gemma3:27b' WHEN 2 THEN 'openai:gpt-4' WHEN 3 THEN 'phi3:mini' WHEN 4 THEN 'ollama:qwen:70b' ELSE 'other' END AS model, p_type AS task, round(p_retailprice / 10000, 6) AS score FROM part"


def named(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(NAMED)


SPEEDS = "CASE model WHEN 'ollama:llama2:13b' THEN 0.85 WHEN 'ollama:gemma3:27b' THEN 0.6 WHEN 'openai:gpt-4' THEN 0.7 WHEN 'phi3:mini' THEN 0.5 WHEN 'ollama:qwen:70b' THEN 0.2 ELSE 0.5 END"
SIZES = "CASE model WHEN 'ollama:llama2:13b' THEN 0.8 WHEN 'ollama:gemma3:27b' THEN 0.7 WHEN 'openai:gpt-4' THEN 0.9 WHEN 'phi3:mini' THEN 0.6 WHEN 'ollama:qwen:70b' THEN 1.0 ELSE 0.6 END"


@query(sql=f"SELECT id, CAST({SPEEDS} AS DOUBLE) AS speed FROM ({NAMED}) AS n")
def speed_score(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).select("id", evaluation.speed_score(F.col("model")).alias("speed"))


@query(sql=f"SELECT id, CAST({SIZES} AS DOUBLE) AS bonus FROM ({NAMED}) AS n")
def size_bonus(spark: SparkSession, d: str) -> DataFrame:
    return named(spark, d).select("id", evaluation.size_bonus(F.col("model")).alias("bonus"))


SELECTED = f"SELECT task, strategy, arg_min(model, (-v, id, model)) AS model, max(v) AS value FROM (SELECT task, id, model, unnest(['performance', 'balanced', 'speed', 'quality']) AS strategy, unnest([round(CAST(score AS DOUBLE), 9), round(score * 0.6 + {SPEEDS} * 0.4, 9), round(CAST({SPEEDS} AS DOUBLE), 9), round(score * 0.8 + {SIZES} * 0.2, 9)]) AS v FROM ({NAMED}) AS n) AS x GROUP BY task, strategy"


@query(sql=SELECTED)
def select_model(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.select_model(named(spark, d).withColumnRenamed("id", "position"))


@query(sql=f"SELECT task, {', '.join(f"max(model) FILTER (strategy = '{n}') AS {n}" for n in evaluation.STRATEGIES)}, any_value(models) AS models FROM ({SELECTED}) AS s JOIN (SELECT task, count(DISTINCT model) AS models FROM ({NAMED}) AS n GROUP BY task) AS m USING (task) GROUP BY task")
def model_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.model_recommendations(named(spark, d).withColumnRenamed("id", "position"))


@query(sql=f"SELECT seq, (CASE WHEN length(trim(instruction)) >= 10 THEN 0.5::DOUBLE WHEN length(trim(instruction)) >= 5 THEN 0.25 ELSE 0 END) + (CASE WHEN length(trim(output)) >= 50 THEN 0.5 WHEN length(trim(output)) >= 20 THEN 0.25 ELSE 0 END) AS score FROM ({INSTR}) AS i")
def score_qa_v1(spark: SparkSession, d: str) -> DataFrame:
    return instructions(spark, d).select("seq", evaluation.qa_score(F.col("instruction"), F.col("output")).alias("score"))


@query(sql="SELECT event_id, CASE WHEN w = 'high' THEN 0.9 WHEN w = 'medium' THEN 0.7 WHEN w = 'low' THEN 0.5 ELSE coalesce(try_cast(w AS DOUBLE), 0.5) END AS confidence FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'sure' ELSE '0.' || (event_id % 97) END AS w FROM events) AS e")
def confidence_normalize(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", F.expr("CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'sure' ELSE concat('0.', event_id % 97) END").alias("w"))
    return own.select("event_id", evaluation.confidence_value(F.col("w")).alias("confidence"))


@query(sql=f"SELECT seq, quality AS decision FROM (SELECT seq, CASE WHEN greatest(0, s - p) >= 0.8 AND NOT c THEN 'accept' WHEN greatest(0, s - p) >= 0.6 THEN 'review' ELSE 'reject' END AS quality FROM (SELECT event_id AS seq, value / 100 AS s, event_type = 'error' AS c, (event_id % 4) / 20.0 AS p FROM events) AS e) AS q")
def quality_decision(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events")
    return own.select(F.col("event_id").alias("seq"), gates.quality_decision(F.col("value") / 100, F.col("event_type") == "error", F.col("event_id") % 4 / 20).alias("decision"))


# ---- scores of responses in three versions; the pairs of conversations are the items, conv_id modulo 9 the model ---------
ITEMS = f"SELECT 'm' || (conv_id % 9) AS model, instruction AS a, output AS b, CASE seq % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'date' ELSE '' END AS kind, (seq % 10) / 10.0 AS c FROM ({INSTR}) AS p"


def items(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE seq % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'date' ELSE '' END")
    return instructions(spark, d).select(F.concat(F.lit("m"), (F.col("conv_id") % 9).cast("string")).alias("model"), F.col("instruction").alias("a"), F.col("output").alias("b"), kind.alias("kind"), (F.col("seq") % 10 / 10).alias("c"))


def _scored(spark: SparkSession, d: str, points: Column, most: float = 1.0, expected: int | None = None) -> DataFrame:
    return evaluation.score_by_model(items(spark, d), points, most, expected).withColumn("score", F.round("score", 9))


@query(sql=f"SELECT model, round(least(avg((CASE WHEN length(trim(a)) >= 10 THEN 0.4::DOUBLE WHEN length(trim(a)) >= 5 THEN 0.2 ELSE 0 END) + (CASE WHEN length(trim(b)) >= 10 THEN 0.3::DOUBLE WHEN length(trim(b)) >= 5 THEN 0.15 ELSE 0 END) + c * 0.3), 1), 9) AS score FROM ({ITEMS}) AS i GROUP BY model")
def score_facts_v1(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, evaluation.fact_score(F.col("a"), F.col("b"), F.col("c")))


@query(sql=f"SELECT model, round(least(avg((CASE WHEN length(a) > 10 THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN length(b) > 5 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN kind = 'date' THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN c > 0.5 THEN 0.1::DOUBLE ELSE 0 END)), 1), 9) AS score FROM ({ITEMS}) AS i GROUP BY model")
def score_facts_v2(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, evaluation.fact_score_v2(F.col("a"), F.col("b"), F.col("kind"), F.col("c")))


@query(sql=f"SELECT model, round(least(avg((CASE WHEN length(a) > 10 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN length(b) > 20 THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN contains(a, '?') THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN {N_WORDS.format('b')} > 10 THEN 0.1::DOUBLE ELSE 0 END)), 1), 9) AS score FROM ({ITEMS}) AS i GROUP BY model")
def score_qa_v2(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, evaluation.qa_score_v2(F.col("a"), F.col("b")))


@query(sql=f"SELECT model, round(least(avg((CASE WHEN length(trim(a)) >= 20 THEN 2.0::DOUBLE WHEN length(trim(a)) >= 10 THEN 1 ELSE 0 END) + (CASE WHEN length(trim(b)) >= 10 THEN 1.0::DOUBLE ELSE 0 END) + (CASE kind WHEN 'general' THEN 0.5::DOUBLE WHEN '' THEN 0 ELSE 1 END) + c) / 5, 1) * 0.8 + least(count(*) / 5, 1) * 0.2, 9) AS score FROM ({ITEMS}) AS i GROUP BY model")
def score_facts_v3(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, evaluation.fact_points_v3(F.col("a"), F.col("b"), F.col("kind"), F.col("c")), 5.0, 5)


@query(sql=f"SELECT id, model FROM ({NAMED}) AS n WHERE contains(model, 'llama') OR contains(model, 'gemma')")
def suitable_models(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.suitable_models(named(spark, d), ("llama", "gemma")).select("id", "model")


@query()
def extract_relations_pattern(spark: SparkSession, d: str) -> DataFrame:
    own = entities(spark, d).withColumn("eid", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lower("name"), "type"), 256))
    return graph.pattern_relations(table(spark, d, "documents"), own)


@query(sql=f"SELECT seq, CASE WHEN len({WORDS.format('instruction')}) >= 5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN NOT starts_with(lower(instruction), 'write a program') AND NOT starts_with(lower(instruction), 'create a') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN (input <> '') = (output <> '') THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE AS checklist FROM ({INSTR}) AS i")
def qa_checklist_score(spark: SparkSession, d: str) -> DataFrame:
    return gates.checklist_score(instructions(spark, d)).select("seq", "checklist")


@query(sql=f"SELECT seq FROM ({INSTR}) AS i WHERE NOT contains(lower(instruction), ' the ') AND NOT contains(lower(output), ' the ') AND length(instruction) >= 15 AND length(output) BETWEEN 50 AND 2000")
def filter_forbidden_phrases(spark: SparkSession, d: str) -> DataFrame:
    return gates.forbidden_filter(instructions(spark, d), (" the ",)).select("seq")


@query(sql=f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing, count(*) >= 1000 AS ok FROM ({INSTR}) AS i")
def training_data_check(spark: SparkSession, d: str) -> DataFrame:
    return gates.training_data_check(instructions(spark, d))


def _grams(n: int) -> str:
    """(seq, side, g, c): how often each run of n words stands in either text."""
    parts = [f"SELECT seq, '{s}' AS side, unnest(list_transform(range(1, len({s}) + {2 - n}), lambda k : {s}[k:k + {n - 1}])) AS g FROM t" for s in "pq"]
    return f"SELECT seq, side, g, count(*) AS c FROM ({' UNION ALL '.join(parts)}) AS x GROUP BY seq, side, g"


def _rouge(n: int) -> str:
    return f"g{n} AS ({_grams(n)}), r{n} AS (SELECT t.seq, coalesce(2 * (SELECT sum(least(a.c, b.c)) FROM g{n} AS a JOIN g{n} AS b ON a.seq = b.seq AND a.g = b.g WHERE a.seq = t.seq AND a.side = 'p' AND b.side = 'q') / (len(p) + len(q) - {2 * n - 2}), 0) AS rouge{n} FROM t)"


@query(sql=f"WITH {LCS}, {_rouge(1)}, {_rouge(2)} SELECT seq, CAST(rouge1 AS DOUBLE) AS rouge1, CAST(rouge2 AS DOUBLE) AS rouge2, rouge_l FROM l JOIN r1 USING (seq) JOIN r2 USING (seq)")
def rouge_eval(spark: SparkSession, d: str) -> DataFrame:
    got = similarity.rouge_n("instruction", "output")
    return instructions(spark, d).select("seq", got["rouge1"].alias("rouge1"), got["rouge2"].alias("rouge2"), similarity.rouge_l("instruction", "output").alias("rouge_l"))


@query()
def select_diverse_seeds(spark: SparkSession, d: str) -> DataFrame:
    seeds = instructions(spark, d).select("seq", gates.category(F.col("instruction")).alias("category"))
    return gates.select_diverse_seeds(seeds, seeds.where("category = 'general'"))


@query(sql=r"SELECT doc_id, 'Score this response.' || chr(10) || 'ACCURACY: 0.0 to 0.3' || chr(10) || 'SPECIFICITY: 0.0 to 0.25' || chr(10) || 'COMPLETENESS: 0.0 to 0.2' || chr(10) || 'RELEVANCE: 0.0 to 0.15' || chr(10) || 'CLARITY: 0.0 to 0.1' || chr(10) || 'TOTAL SCORE: the sum' || chr(10) || chr(10) || 'DOCUMENT:' || chr(10) || text[1:2000] || chr(10) || chr(10) || 'RESPONSE:' || chr(10) || source AS prompt FROM documents")
def render_prompt_scoring(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").withColumnRenamed("source", "response")
    return parsing.scoring_prompt(own, "fact_extraction").select("doc_id", "prompt")


@query(
    sql=f"""{WITH}, g AS (SELECT * FROM nodes WHERE confidence >= 0.5),
  e AS (SELECT * FROM edges WHERE strength >= 0.4 AND src IN (SELECT id FROM g) AND dst IN (SELECT id FROM g)),
  k AS (SELECT lower(name) AS k, type, arg_min(id, (-mentions, id)) AS top FROM g GROUP BY 1, 2 HAVING count(*) > 1),
  p AS (SELECT id, top FROM g JOIN k ON lower(name) = k AND g.type = k.type WHERE id <> top),
  m AS (SELECT coalesce(s.top, src) AS src, coalesce(t.top, dst) AS dst, e.type, s.top IS NOT NULL OR t.top IS NOT NULL AS moved FROM e LEFT JOIN p AS s ON src = s.id LEFT JOIN p AS t ON dst = t.id),
  stay AS (SELECT * FROM m WHERE NOT moved),
  after AS (SELECT src, dst, type FROM stay UNION SELECT src, dst, 'RELATED_TO' FROM m WHERE moved AND src <> dst AND NOT EXISTS (SELECT 1 FROM stay WHERE stay.src = m.src AND stay.dst = m.dst))
SELECT 'before' AS stage, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges
UNION ALL SELECT 'cleaned', (SELECT count(*) FROM g), (SELECT count(*) FROM e)
UNION ALL SELECT 'after', (SELECT count(*) FROM g) - (SELECT count(*) FROM p), (SELECT count(*) FROM after)"""
)
def optimize_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.optimize(nodes(spark, d), edges(spark, d))[2]


@query(sql=f"{WITH}, q AS (SELECT item_id AS query_id, 'machinery ' || (item_id % 7) AS term FROM benchmark), s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY quality_score DESC, confidence DESC, id) AS r FROM q, nodes WHERE contains(lower(name), term)), b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) SELECT DISTINCT query_id, id FROM (SELECT query_id, id FROM s WHERE r <= 10 UNION SELECT query_id, dst FROM s JOIN b ON src = id WHERE r <= 10) AS x")
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("MACHINERY "), (F.col("item_id") % 7).cast("string")).alias("name"))
    return answering.graph_context(asked, nodes(spark, d), edges(spark, d), depth=1)


@query(sql="WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') / count(*) AS success, avg(value) / 100 AS filter_accuracy, least(count(DISTINCT user_id) / 100, 1.0) AS speed FROM events) SELECT n, success, round(filter_accuracy, 9) AS filter_accuracy, speed, round((success + filter_accuracy + speed) / 3, 9) AS overall, CASE WHEN (success + filter_accuracy + speed) / 3 >= 0.9 THEN 'excellent' WHEN (success + filter_accuracy + speed) / 3 >= 0.7 THEN 'good' WHEN (success + filter_accuracy + speed) / 3 >= 0.5 THEN 'fair' ELSE 'poor' END AS status FROM e")
def agent_performance_report(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").agg(
        F.count("*").alias("n"),
        (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("success"),
        (F.avg("value") / 100).alias("filter_accuracy"),
        F.least(F.count_distinct("user_id") / 100, F.lit(1.0)).alias("speed"),
    )
    got = evaluation.performance_report(own, "success", "filter_accuracy", "speed")
    return got.withColumns({c: F.round(c, 9) for c in ("filter_accuracy", "overall")})


@query(sql=f"WITH i AS ({INSTR}), m AS (SELECT count(*) AS n, count(DISTINCT instruction) / count(*) AS diversity FROM i) SELECT 'parse_success' AS item, 1.0::DOUBLE AS value, TRUE AS ok, TRUE AS critical FROM m UNION ALL SELECT 'diversity', diversity, diversity > 0.7, FALSE FROM m UNION ALL SELECT 'target', CAST(n AS DOUBLE), n >= 200, TRUE FROM m")
def generation_checklist(spark: SparkSession, d: str) -> DataFrame:
    return gates.generation_checklist(instructions(spark, d), target=200)
