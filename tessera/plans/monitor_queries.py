"""Queries of response parsing, answer scores, and the monitoring tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answering, parsing, retrieval
from tessera.plans.registry import query, table
from tessera.plans.text_queries import INSTR, N_WORDS, instructions
from tessera.streaming import monitoring


# ---- parsing: responses made of the conversations' and documents' texts --------------------------
def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


RESPONSES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'Here is the JSON: ' || props WHEN 2 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 3 THEN '<think>{no}</think>Okay [' || props || '] Hope this helps.' WHEN 4 THEN 'nothing' ELSE 'TOTAL SCORE: ' || (event_id % 7) / 5.0 || ' ACCURACY: 0.2 CLARITY: 0.9' END AS response FROM events"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    events(spark, d).createOrReplaceTempView("events")
    return spark.sql(RESPONSES.replace("5.0", "5.0D").replace("chr(10)", "char(10)"))


@query(sql=rf"SELECT event_id, CASE WHEN f = '' THEN '[]' ELSE f END AS json FROM (SELECT event_id, regexp_extract(replace(replace(regexp_replace(response, '<think>[^<]*</think>', '', 'g'), '```json', ''), '```', ''), '(?s)(\[.*\]|\{{.*\}})', 1) AS f FROM ({RESPONSES}) AS r) AS g")
def json_first_array_or_object(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("event_id", parsing.first_array_or_object(F.col("response")).alias("json"))


@query()
def json_extract_robust(spark: SparkSession, d: str) -> DataFrame:
    return parsing.extract_json(responses(spark, d)).drop("response")


@query(sql=f"SELECT event_id, CASE WHEN event_id % 6 = 5 THEN least(1.0, (event_id % 7) / 5.0) ELSE 0.0 END AS score FROM events")
def parse_total_score(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("event_id", parsing.total_score(F.col("response"), "fact_extraction").alias("score"))


@query(sql="SELECT event_id, least(value / 100, 9) AS format_consistency, 0.5::DOUBLE AS quality_stability FROM (SELECT event_id, round(value, 2) AS value FROM events) AS e")
def parse_consistency_scores(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).select("event_id", F.concat(F.lit("FORMAT_CONSISTENCY: "), F.format_string("%.2f", F.round("value", 2)), F.lit(" good")).alias("response"))
    got = parsing.consistency_scores(F.col("response"))
    return own.select("event_id", (got["format_consistency"] / 100).alias("format_consistency"), got["quality_stability"].alias("quality_stability"))


@query(sql=f"SELECT seq, CASE WHEN a <> '' AND b <> '' THEN a END AS instruction, CASE WHEN a <> '' AND b <> '' THEN b END AS output FROM (SELECT seq, trim(instruction, ' ' || chr(10)) AS a, trim(output, ' ' || chr(10)) AS b FROM ({INSTR}) AS i) AS j")
def parse_instruction_response(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(instructions(spark, d), F.col("instruction"), F.col("output"))


def _parsed(own: DataFrame, instruction: Column, output: Column) -> DataFrame:
    a, b = F.trim(instruction, F.lit(" \n")), F.trim(output, F.lit(" \n"))
    made = own.select("seq", F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(a.alias("instruction"), F.lit("").alias("input"), b.alias("output")))).otherwise(F.concat(F.lit("Instruction: "), a, F.lit("\nInput: none\nOutput: "), b)).alias("response"))
    got = parsing.parse_instruction(F.col("response"))
    return made.select("seq", got["instruction"].alias("instruction"), got["output"].alias("output"))


@query(sql=f"SELECT seq, 'Below is an instruction that describes a task' || CASE WHEN seq % 2 = 0 THEN ', paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || 'x' ELSE '. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || instruction END || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM ({INSTR}) AS i")
def render_train_template(spark: SparkSession, d: str) -> DataFrame:
    own = instructions(spark, d).withColumn("input", F.when(F.col("seq") % 2 == 0, "x").otherwise(""))
    return parsing.train_template(own).select("seq", "prompt")


# ---- answers: one for each conversation pair, contexts counted from its ids ------------------------
ANSWERS = f"SELECT seq, output AS answer, CAST(seq % 13 AS INTEGER) AS entities, CAST(seq % 4 AS INTEGER) AS relations, (seq % 10) / 10.0 AS graph_confidence, CASE WHEN seq % 3 > 0 THEN (seq % 9) / 10.0 END AS similarity FROM ({INSTR}) AS i"
_GRAPH = "CASE WHEN entities > 0 THEN graph_confidence * 0.5 + least(entities / 10, 1) * 0.3 + least(relations / 5, 1) * 0.2 END"
_MEAN = "list_avg(list_filter([{0}], lambda x : x IS NOT NULL))"
CONFIDENCE = _MEAN.format(f"CAST({_GRAPH} AS DOUBLE), CAST(similarity AS DOUBLE), CAST(least({N_WORDS.format('answer')} / 50, 1) AS DOUBLE)")


def answers(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    return instructions(spark, d).select("seq", F.col("output").alias("answer"), (s % 13).cast("int").alias("entities"), (s % 4).cast("int").alias("relations"), (s % 10 / 10).alias("graph_confidence"), F.when(s % 3 > 0, s % 9 / 10).alias("similarity"))


def _confidence():  # noqa: ANN202
    return answering.answer_confidence(*(F.col(c) for c in ("entities", "relations", "graph_confidence", "similarity", "answer")))


@query(sql=f"SELECT seq, round({CONFIDENCE}, 9) AS confidence FROM ({ANSWERS}) AS a")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("seq", F.round(_confidence(), 9).alias("confidence"))


@query(sql=f"SELECT seq, round({_MEAN.format(f'CASE WHEN entities > 0 AND similarity IS NOT NULL THEN 1.0::DOUBLE WHEN entities > 0 OR similarity IS NOT NULL THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END, CASE WHEN entities > 0 THEN graph_confidence::DOUBLE END, similarity::DOUBLE, {CONFIDENCE}')}, 9) AS quality FROM ({ANSWERS}) AS a")
def result_quality(spark: SparkSession, d: str) -> DataFrame:
    got = answering.result_quality(F.col("entities"), F.col("graph_confidence"), F.col("similarity"), _confidence())
    return answers(spark, d).select("seq", F.round(got, 9).alias("quality"))


@query(sql=f"SELECT seq, array_to_string(list_filter([CASE WHEN entities > 0 THEN 'Found ' || entities || ' relevant entities and ' || relations || ' relationships in knowledge graph' END, CASE WHEN similarity IS NOT NULL THEN 'Retrieved 3 relevant document excerpts' END, CASE WHEN similarity IS NOT NULL THEN printf('Average document similarity: %.2f', similarity::DOUBLE) END, CASE WHEN entities > 0 AND similarity IS NOT NULL THEN 'Combined graph and vector contexts for comprehensive answer' WHEN entities > 0 THEN 'Used primarily knowledge graph context' WHEN similarity IS NOT NULL THEN 'Used primarily document vector context' ELSE 'Limited context available - answer may be incomplete' END], lambda x : x IS NOT NULL), '; ') AS path FROM ({ANSWERS}) AS a")
def reasoning_path(spark: SparkSession, d: str) -> DataFrame:
    excerpts = F.when(F.col("similarity").isNotNull(), 3).otherwise(0)
    return answers(spark, d).select("seq", F.array_join(answering.reasoning_path(F.col("entities"), F.col("relations"), excerpts, F.col("similarity")), "; ").alias("path"))


@query(sql="SELECT o_custkey AS query_id, count(DISTINCT CASE WHEN hit THEN n END) / count(DISTINCT n) AS coverage FROM (SELECT o_custkey, lower(o_orderpriority) AS n, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey, o_orderpriority) AS hit FROM orders) AS o GROUP BY o_custkey")
def coverage_score(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("name"), "o_orderstatus")
    return answering.coverage_score(own, own.where("o_orderstatus = 'F'"))


@query(sql="SELECT doc_id % 40 AS query_id, 'graph' AS kind, CAST(doc_id AS VARCHAR) AS source, NULL AS excerpt FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id % 40, 'document', CAST(doc_id AS VARCHAR), text[1:200] || '...' FROM documents WHERE lang = 'de'")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") % 40).alias("query_id"), "doc_id")
    two = table(spark, d, "documents").where("lang = 'de'").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", "text")
    return answering.answer_sources(one, two)


@query()
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", retrieval.embed_hash(F.col("text"), 8).alias("embedding"))


# ---- monitoring ------------------------------------------------------------------------------------
@query(sql="SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def log_append(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.recent(events(spark, d), 1000).select("event_id", "ts", "user_id", "event_type")


@query(sql="SELECT event_id, ts, event_type FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 20")
def log_recent(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.recent(events(spark, d), 20, F.col("user_id") == 8).select("event_id", "ts", "event_type")


@query(sql="SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.latest_state(events(spark, d), "user_id", "event_type").select("user_id", "event_type", "ts", "value")


@query(sql="SELECT user_id, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) AS e WHERE r <= 100")
def history_last_100(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.history(events(spark, d), "user_id").select("user_id", "event_id", "rank")


@query(sql="SELECT event_id, round(value / greatest((event_id % 5) / 10.0, 0.001), 6) AS tps FROM events")
def tokens_per_second(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(monitoring.tokens_per_second(F.col("value"), F.col("event_id") % 5 / 10), 6).alias("tps"))


@query(sql="SELECT user_id, done, round(elapsed, 3) AS elapsed, round(done / greatest(elapsed, 1), 9) AS rate, round(greatest(1000 - done, 0) / greatest(done / greatest(elapsed, 1), 0.001), 3) AS eta FROM (SELECT user_id, count(*) AS done, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS elapsed FROM events GROUP BY user_id) AS e")
def progress_rate_eta(spark: SparkSession, d: str) -> DataFrame:
    got = monitoring.progress(events(spark, d), "user_id", 1000)
    return got.select("user_id", "done", F.round("elapsed", 3).alias("elapsed"), F.round("rate", 9).alias("rate"), F.round("eta", 3).alias("eta"))


@query(sql="SELECT user_id, event_type AS metric, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def quality_metrics_merge(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.merge_metrics(events(spark, d).withColumnRenamed("event_type", "metric"), "user_id")


@query(sql="SELECT event_id FROM events WHERE NOT (event_type IN ('purchase', 'error') AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOUR)")
def expire_completed(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.expire_completed(events(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp"), ("purchase", "error")).select("event_id")


@query(sql="SELECT user_id, event_type FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) AS s WHERE event_type = 'view'")
def active_workflows(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.latest_state(events(spark, d), "user_id").where("event_type = 'view'").select("user_id", "event_type")


@query(sql="SELECT start, count(*) AS n, round(avg(value), 6) AS average, count(*) >= 100 AND avg(value) < 50 AS retrain FROM (SELECT make_timestamp(epoch_us(ts) // 604800000000 * 604800000000) AS start, value FROM events) AS e GROUP BY start")
def feedback_retrain_trigger(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.windowed_rating(events(spark, d), below=50.0).withColumn("average", F.round("average", 6))


@query(sql="SELECT model, total, successes, successes / total AS success_rate FROM (SELECT 'm' || user_id AS model, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successes FROM events GROUP BY user_id) AS e")
def assistance_summary(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).groupBy(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"))
    return own.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("successes")).withColumn("success_rate", F.col("successes") / F.col("total"))
