"""Queries of prompts and of the checks of a whole data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answering, chunking, gates, parsing
from tessera.plans.graph_queries import edges, nodes
from tessera.plans.more_queries import REACHED, asked
from tessera.plans.registry import query, table
from tessera.plans.text_queries import CATEGORY, INSTR, TOPICS, instructions

NL = "chr(10)"
CLOSING = "Answer from the entities, relationships and documents above and name those used. Say so where they are not enough. End with your confidence: High, Medium or Low."


@query(
    sql=f"""{REACHED}, t AS (SELECT r.query_id, id, r.name, type FROM r JOIN nodes USING (id)),
  nl AS (SELECT query_id, string_agg('- ' || name || ' (' || type || ')', {NL} ORDER BY id) AS nodes FROM t GROUP BY query_id),
  e AS (SELECT DISTINCT a.query_id, edges.src, edges.dst, edges.type, a.name AS a, z.name AS z FROM edges JOIN t AS a ON src = a.id JOIN t AS z ON dst = z.id AND z.query_id = a.query_id),
  el AS (SELECT query_id, string_agg('- ' || a || ' ' || type || ' ' || z, {NL} ORDER BY k) AS related FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, type) AS k FROM e) AS x WHERE k <= 10 GROUP BY query_id),
  d AS (SELECT doc_id % 40 AS query_id, text, (doc_id % 10) / 10 AS similarity, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id % 10 DESC, doc_id) AS k FROM documents),
  dl AS (SELECT query_id, string_agg('[similarity ' || printf('%.2f', similarity) || '] ' || CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END, {NL} ORDER BY k) AS found FROM d WHERE k <= 3 GROUP BY query_id)
SELECT query_id, concat_ws({NL} || {NL}, 'QUESTION: ' || text, 'ENTITIES:' || {NL} || nodes, 'RELATIONSHIPS:' || {NL} || related, 'DOCUMENTS:' || {NL} || found, '{CLOSING}') AS prompt
FROM q LEFT JOIN nl USING (query_id) LEFT JOIN el USING (query_id) LEFT JOIN dl USING (query_id)"""
)
def render_prompt_answer(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    own = nodes(spark, d)
    reached = answering.graph_context(asked(spark, d), own, edges(spark, d), 1).join(own.select("id", "name", "type"), "id")
    excerpts = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", "text", (F.col("doc_id") % 10 / 10).alias("similarity"))
    return answering.answer_prompt(questions, reached, edges(spark, d), excerpts)


@query(
    sql=f"""SELECT doc_id, concat_ws({NL}, 'Write one new instruction with its input and output as JSON with the keys instruction, input, output.',
  'Context: ' || text[1:300], 'Topics: ' || array_to_string(coalesce(topics, []) [1:5], ', '), 'Example: ' || source) AS prompt FROM documents LEFT JOIN ({TOPICS}) AS t USING (doc_id)"""
)
def render_prompt_generation(spark: SparkSession, d: str) -> DataFrame:
    own = chunking.with_topics(table(spark, d, "documents").select("doc_id", F.col("text").alias("context"), F.col("source").alias("seed"), "text"))
    return parsing.generation_prompt(own).select("doc_id", "prompt")


def _scoring(task: str, name: str) -> None:
    lines = f" || {NL} || ".join(f"'{n.upper()}: 0.0 to {w}'" for n, w in parsing.CRITERIA[task].items())

    @query(name=name, sql=f"SELECT doc_id, 'Score this response.' || {NL} || {lines} || {NL} || 'TOTAL SCORE: the sum' || {NL} || {NL} || 'DOCUMENT:' || {NL} || text[1:2000] || {NL} || {NL} || 'RESPONSE:' || {NL} || lang AS prompt FROM documents")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return parsing.scoring_prompt(table(spark, d, "documents").withColumnRenamed("lang", "response"), task).select("doc_id", "prompt")


_scoring("concept_extraction", "render_prompt_concepts")
_scoring("analytical_qa", "render_prompt_qa")


@query(
    sql=f"""WITH i AS (SELECT instruction, input, CASE WHEN seq % 7 = 0 THEN ' ' ELSE output END AS output FROM ({INSTR}) AS x UNION ALL SELECT instruction, input, output FROM ({INSTR}) AS x WHERE conv_id % 9 = 0),
  g AS (SELECT instruction, input, output, count(*) AS n FROM i GROUP BY ALL), c AS (SELECT {CATEGORY} AS category, sum(n) AS n FROM g GROUP BY 1), s AS (SELECT CAST(sum(n) AS DOUBLE) AS total, count(*) AS d, sum(n) FILTER (regexp_matches(instruction, '\\S') AND regexp_matches(output, '\\S')) AS good FROM g)
SELECT 'size' AS item, total AS value, total >= 200 AS ok, 0.2::DOUBLE AS weight FROM s
UNION ALL SELECT 'balance', (SELECT max(n) FROM c) / total, (SELECT max(n) FROM c) / total <= 0.5, 0.3 FROM s
UNION ALL SELECT 'duplicates', (total - d) / total, (total - d) / total < 0.05, 0.3 FROM s
UNION ALL SELECT 'format', good / total, good = total, 0.2 FROM s"""
)
def qa_dataset_checklist(spark: SparkSession, d: str) -> DataFrame:
    own = instructions(spark, d)
    blank = own.withColumn("output", F.when(F.col("seq") % 7 == 0, " ").otherwise(F.col("output")))
    again = own.where("conv_id % 9 = 0")
    return gates.dataset_checklist(blank.select("instruction", "input", "output").unionByName(again.select("instruction", "input", "output")), least=200)
