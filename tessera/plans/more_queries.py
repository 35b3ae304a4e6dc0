"""Queries of parsed items, near duplicates, concept scores, graph merges and answers over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answering, evaluation, gates, graph, parsing, retrieval, similarity
from tessera.operators.chunking import word_chunks
from tessera.plans.graph_queries import BOARD, ITEMS, WITH, board, edges, items, nodes, scores
from tessera.plans.registry import query, table
from tessera.plans.text_queries import INSTR, WORDS, instructions


# ---- parsed items: each conversation is a response that lists its turns ----------------------------
def facts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("conv_id") % 2 == 1, F.lit("date"))
    sure = F.when(F.col("conv_id") % 3 == 2, F.lit("sure")).otherwise(F.lit("high"))
    each = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("context"), kind.alias("fact_type"), sure.alias("confidence")))
    return _listed(table(spark, d, "conversations"), each)


def concepts(spark: SparkSession, d: str) -> DataFrame:
    own = [F.col("role").alias("name"), F.col("text").alias("definition"), F.lit("talk").alias("domain"), F.lit("low").alias("confidence")]
    each = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(*own, F.split("text", " ").alias("examples")))).otherwise(F.to_json(F.struct(*own, F.col("text").alias("examples"))))
    return _listed(table(spark, d, "conversations"), each)


def _listed(rows: DataFrame, each: Column) -> DataFrame:
    found = rows.select("conv_id", "turn", each.alias("j")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "j"))).alias("all"))
    return found.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


TURNS = "(SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos FROM conversations)"


@query(sql=f"SELECT conv_id, pos, text AS content, role AS context, CASE WHEN conv_id % 2 = 1 THEN 'date' ELSE 'general' END AS fact_type, CASE WHEN conv_id % 3 = 2 THEN 'sure' ELSE 'high' END AS confidence FROM {TURNS} AS t WHERE pos < 5")
def explode_facts(spark: SparkSession, d: str) -> DataFrame:
    return parsing.explode_facts(facts(spark, d))


@query(sql=f"SELECT conv_id, pos, role AS name, text AS definition, 'talk' AS domain, 'low' AS confidence, CAST(len(string_split(text, ' ')) AS INTEGER) AS examples FROM {TURNS} AS t WHERE pos < 3 AND conv_id % 2 = 0")
def explode_concepts(spark: SparkSession, d: str) -> DataFrame:
    return parsing.explode_concepts(concepts(spark, d).where("conv_id % 2 = 0")).withColumn("examples", F.size("examples")).drop("relationships")


@query(sql="SELECT conv_id, conv_id % 2 = 1 AND conv_id % 3 <> 2 AS valid FROM conversations GROUP BY conv_id")
def validate_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("conv_id", parsing.valid_facts(F.col("json")).alias("valid"))


@query(sql="SELECT conv_id, conv_id % 2 = 0 AS valid FROM conversations GROUP BY conv_id")
def validate_concepts(spark: SparkSession, d: str) -> DataFrame:
    return concepts(spark, d).select("conv_id", parsing.valid_concepts(F.col("json")).alias("valid"))


# ---- gates ------------------------------------------------------------------------------------------
@query(sql=f"WITH i AS (SELECT seq, list_sort(list_distinct({WORDS.format('lower(instruction)')})) AS w FROM ({INSTR}) AS x) SELECT seq FROM i AS a WHERE NOT EXISTS (SELECT 1 FROM i AS b WHERE b.seq < a.seq AND (a.w = b.w OR (len(a.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))))")
def dedup_near(spark: SparkSession, d: str) -> DataFrame:
    return similarity.dedup_near(instructions(spark, d)).select("seq")


@query(sql="SELECT count(*) AS generated, CAST(12000 AS INTEGER) AS target, count(*) / 12000 AS completion_rate, CAST(epoch(max(ts)) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS seconds FROM (SELECT date_trunc('second', ts) AS ts FROM events) AS e")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").withColumn("ts", F.date_trunc("second", "ts"))
    return gates.run_statistics(own, 12000, "ts", "ts")


# ---- scores of concepts and pairs --------------------------------------------------------------------
#: Examples and relationships of an item: the parts of its texts between commas and points.
LISTED = f"(SELECT *, string_split(b, ',') AS ex, string_split(a, '.') AS rel FROM ({ITEMS}) AS w)"


def listed(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).withColumns({"ex": F.split("b", ","), "rel": F.split("a", r"\.")})


def _by_model(rows: DataFrame, points: Column, most: float = 1.0, expected: int | None = None) -> DataFrame:
    return evaluation.score_by_model(rows, points, most, expected).withColumn("score", F.round("score", 9))


_step = lambda text, *steps: "(CASE " + " ".join(f"WHEN length(trim({text})) >= {n} THEN {x}::DOUBLE" for n, x in steps) + " ELSE 0 END)"


@query(sql=f"SELECT model, round(least(avg({_step('a', (3, 0.2))} + {_step('b', (20, 0.4), (10, 0.2))} + 0.2 + 0.2), 1), 9) AS score FROM {LISTED} AS i GROUP BY model")
def score_concepts_v1(spark: SparkSession, d: str) -> DataFrame:
    return _by_model(listed(spark, d), evaluation.concept_score(F.col("a"), F.col("b"), F.col("ex"), F.col("rel")))


@query(sql=f"SELECT model, round(least(avg((CASE WHEN length(a) > 3 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN length(b) > 10 THEN 0.4::DOUBLE ELSE 0 END) + 0.2 + (CASE WHEN c > 0.5 THEN 0.1::DOUBLE ELSE 0 END)), 1), 9) AS score FROM {LISTED} AS i GROUP BY model")
def score_concepts_v2(spark: SparkSession, d: str) -> DataFrame:
    return _by_model(listed(spark, d), evaluation.concept_score_v2(F.col("a"), F.col("b"), F.col("ex"), F.col("c")))


@query(sql=f"SELECT model, round(least(avg({_step('a', (3, 1.0))} + {_step('b', (50, 2.0), (20, 1.0), (5, 0.5))} + (CASE WHEN len(list_filter(ex, lambda x : length(trim(x)) >= 3)) >= 2 THEN 1.0::DOUBLE WHEN len(list_filter(ex, lambda x : length(trim(x)) >= 3)) >= 1 THEN 0.5 ELSE 0 END) + (CASE WHEN len(list_filter(rel, lambda x : length(trim(x)) >= 3)) >= 1 THEN 1.0::DOUBLE ELSE 0 END) + c) / 6, 1) * 0.8 + least(count(*) / 3, 1) * 0.2, 9) AS score FROM {LISTED} AS i GROUP BY model")
def score_concepts_v3(spark: SparkSession, d: str) -> DataFrame:
    return _by_model(listed(spark, d), evaluation.concept_points_v3(F.col("a"), F.col("b"), F.col("ex"), F.col("rel"), F.col("c")), 6.0, 3)


NWORDS = f"len({WORDS.format('{0}')})"


@query(sql=f"SELECT model, round(least(avg((CASE WHEN {NWORDS.format('a')} >= 3 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN {NWORDS.format('b')} >= 5 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN {NWORDS.format('a')} >= 3 AND {NWORDS.format('b')} >= 5 AND lower(trim(a)) <> lower(trim(b)) THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN ({' OR '.join(f'contains(lower(a), {w!r})' for w in evaluation.ANALYTICAL)}) AND b <> '' THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN {NWORDS.format('b')} >= 30 AND a <> '' THEN 0.5::DOUBLE ELSE 0 END)) / 4, 1), 9) AS score FROM {LISTED} AS i GROUP BY model")
def score_qa_v3(spark: SparkSession, d: str) -> DataFrame:
    return _by_model(listed(spark, d), evaluation.qa_points_v3(F.col("a"), F.col("b")), 4.0)


@query(sql=f"{BOARD}, h AS (SELECT 'm' || user_id AS model, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT model, round(total, 9) AS total, round(total / possible * 100, 6) AS percent, coalesce(n, 0) AS assistance FROM board LEFT JOIN h USING (model) WHERE contains(model, '7')")
def model_subset_analysis(spark: SparkSession, d: str) -> DataFrame:
    helped = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"))
    own = board(spark, d).withColumn("percent", F.round("percent", 6))
    return evaluation.model_subset_analysis(own, own.where(F.contains("model", F.lit("7"))), helped)


@query(sql=f"{BOARD} SELECT 'overall' AS kind, arg_min(model, (-round(total, 9), model)) AS model, max(round(total, 9)) AS score FROM board UNION ALL SELECT task, arg_min(model, (-score, model)), max(score) FROM latest WHERE score > 0 GROUP BY task")
def evaluation_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluation_recommendations(board(spark, d), evaluation.latest_scores(scores(spark, d)))


# ---- the graph: merges ---------------------------------------------------------------------------------
@query(sql=f"{WITH}, v AS (SELECT src, dst, type, strength, 1 AS updated_at FROM edges UNION ALL SELECT src, dst, type, 0.9, 2 FROM edges WHERE type = 'NEXT_TO' UNION ALL SELECT dst, src, 'HOLDS', strength, 2 FROM edges WHERE type = 'LOCATED_IN'), g AS (SELECT id FROM nodes WHERE confidence > 0.2) SELECT src, dst, type, arg_max(strength, (updated_at, strength)) AS strength FROM v WHERE src IN (SELECT id FROM g) AND dst IN (SELECT id FROM g) GROUP BY src, dst, type")
def graph_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    own = edges(spark, d).select("src", "dst", "type", "strength", F.lit(1).alias("updated_at"))
    new = own.where("type = 'NEXT_TO'").withColumns({"strength": F.lit(0.9), "updated_at": F.lit(2)})
    more = own.where("type = 'LOCATED_IN'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("HOLDS").alias("type"), "strength", F.lit(2).alias("updated_at"))
    return graph.upsert_edges(own, new.unionByName(more), nodes(spark, d).where("confidence > 0.2")).drop("updated_at")


@query(sql="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS updated_at FROM documents")
def graph_upsert_docs(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", "source", F.lit(1).alias("updated_at"))
    return graph.upsert_docs(own, own.where("doc_id % 3 = 0").withColumns({"source": F.lit("new"), "updated_at": F.lit(2)}))


@query(sql=f"{WITH}, m AS (SELECT 'c' || user_id AS id, event_id % 500 AS doc_id, event_type AS context, ts AS created_at FROM events) SELECT id, doc_id, arg_max(context, (created_at, context)) AS context FROM m WHERE id IN (SELECT id FROM nodes) AND doc_id IN (SELECT doc_id FROM documents) GROUP BY id, doc_id")
def graph_link_mentions(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("id"), (F.col("event_id") % 500).alias("doc_id"), F.col("event_type").alias("context"), F.col("ts").alias("created_at"))
    return graph.link_mentions(own, nodes(spark, d), table(spark, d, "documents"))


@query(sql=f"{WITH}, n AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) AS x GROUP BY id) SELECT id, round(confidence * 0.5 + least(mentions / 10, 1) * 0.3 + least(coalesce(n, 0) / 5, 1) * 0.2, 9) AS quality_score FROM nodes LEFT JOIN n USING (id)")
def recompute_quality(spark: SparkSession, d: str) -> DataFrame:
    return graph.recompute_quality(nodes(spark, d), edges(spark, d)).select("id", F.round("quality_score", 9).alias("quality_score"))


@query(sql="SELECT count(*) AS chunks FROM (SELECT doc_id, unnest(range(0, CAST(ceil(len(list_filter(regexp_split_to_array(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x : x <> '')) / 500) AS BIGINT))) AS k FROM documents WHERE doc_id % 4 <> 1) AS c")
def delete_index(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents")
    return retrieval.delete_index(word_chunks(own), own.where("doc_id % 4 = 1")).agg(F.count("*").alias("chunks"))


# ---- answers over the graph ----------------------------------------------------------------------------
def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("MACHINERY "), (F.col("item_id") % 7).cast("string")).alias("name"))


REACHED = f"{WITH}, q AS (SELECT item_id AS query_id, 'machinery ' || (item_id % 7) AS term, text FROM benchmark), s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY quality_score DESC, confidence DESC, id) AS r FROM q, nodes WHERE contains(lower(name), term)), b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), x AS (SELECT query_id, id FROM s WHERE r <= 10 UNION SELECT query_id, dst FROM s JOIN b ON src = id WHERE r <= 10), r AS (SELECT query_id, id, name, confidence FROM x JOIN nodes USING (id))"


@query(sql=f"{REACHED} SELECT query_id, round(avg(confidence), 9) AS avg_confidence FROM r GROUP BY query_id")
def avg_confidence(spark: SparkSession, d: str) -> DataFrame:
    found = answering.graph_context(asked(spark, d), nodes(spark, d), edges(spark, d), 1).join(nodes(spark, d).select("id", "confidence"), "id")
    return answering.avg_confidence(found).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(
    sql=f"""{REACHED}, n AS (SELECT query_id, count(*) AS entities, avg(confidence) AS c FROM r GROUP BY query_id),
  e AS (SELECT query_id, count(DISTINCT (edges.src, edges.dst, edges.type)) AS relations FROM edges JOIN r AS a ON src = a.id JOIN r AS z USING (query_id) WHERE dst = z.id GROUP BY query_id),
  h AS (SELECT q.query_id, CAST(bool_or(lower(name) = term) AS INTEGER)::DOUBLE AS coverage FROM q LEFT JOIN r USING (query_id) GROUP BY q.query_id),
  v AS (SELECT doc_id % 40 AS query_id, count(*) AS excerpts, avg((doc_id % 10) / 10.0) AS similarity FROM documents GROUP BY 1),
  f AS (SELECT q.query_id, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations, coalesce(c, 0) AS c, coalesce(excerpts, 0) AS excerpts, similarity, coalesce(coverage, 0) AS coverage, least(len({WORDS.format('text')}) / 50, 1) AS w FROM q LEFT JOIN n USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN v USING (query_id)),
  g AS (SELECT *, list_avg(list_filter([CASE WHEN entities > 0 THEN c * 0.5 + least(entities / 10, 1) * 0.3 + least(relations / 5, 1) * 0.2 END, similarity, w], lambda x : x IS NOT NULL)) AS confidence FROM f)
SELECT query_id, entities, relations, excerpts, round(coverage, 9) AS coverage, round(confidence, 9) AS confidence,
  round(list_avg(list_filter([CASE WHEN entities > 0 AND similarity IS NOT NULL THEN 1.0 WHEN entities > 0 OR similarity IS NOT NULL THEN 0.7 ELSE 0.3 END, CASE WHEN entities > 0 THEN c END, similarity, confidence], lambda x : x IS NOT NULL)), 9) AS quality FROM g"""
)
def graph_rag_query(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    excerpts = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("query_id"), (F.col("doc_id") % 10 / 10).alias("similarity"))
    got = answering.graph_rag_query(own, asked(spark, d), nodes(spark, d), edges(spark, d), excerpts, own, depth=1)
    return got.select("query_id", "entities", "relations", "excerpts", *[F.round(c, 9).alias(c) for c in ("coverage", "confidence", "quality")])


@query()
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    return answering.query_entities(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text"))


# ---- entities by a table of patterns -------------------------------------------------------------------
CUSTOM = (("Metric", 0.9, False, "[0-9]+(?:[.][0-9]+)?%"), ("Section", None, None, "[A-Z][a-z]+ [0-9]+"), ("Link", 0.6, True, "(?:and|with) the"))


@query(sql="SELECT doc_id, type, name, confidence, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, {c or 0.5}::DOUBLE AS confidence, unnest(regexp_extract_all(text, '{'(?i)' * bool(i)}{r}')) AS name FROM documents" for t, c, i, r in CUSTOM) + ") AS m GROUP BY doc_id, type, name, confidence")
def custom_entity_patterns(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame(CUSTOM, "type string, confidence double, ignore_case boolean, pattern string")
    found = graph.extract_entities(table(spark, d, "documents"), graph.pattern_table(given))
    return found.groupBy("doc_id", "type", "name", "confidence").agg(F.count("*").alias("n"))
