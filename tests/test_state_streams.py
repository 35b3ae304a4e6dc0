"""Streams with keyed state give what the same operators give for a table; a repeated batch leaves each row once."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates
from tessera.streaming import monitoring, state


@pytest.fixture
def fed(spark, tmp_path):
    """(events, a way to run a stream over one further third of them at a time)."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").limit(600).cache()
    cuts = [r[0] for r in events.selectExpr("percentile_approx(ts, array(0.4, 0.7), 10000) as c").select(F.explode("c")).collect()]
    parts = [events.where(F.col("ts") < cuts[0]), events.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), events.where(F.col("ts") >= cuts[1])]
    source = str(tmp_path / "in")

    def run(make):
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(source)
            make(spark.readStream.schema(events.schema).parquet(source))

    return events, run


def test_history_on_a_stream_equals_history_of_a_table(spark, tmp_path, fed):
    events, run = fed
    run(lambda s: state.write_changes(state.history_stream(s, "user_id", 3), str(tmp_path / "out"), str(tmp_path / "seen")))
    got = state.current(spark, str(tmp_path / "out"), "user_id")
    columns = [*events.columns, "rank"]
    want = monitoring.history(events, "user_id", 3).select(columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch", "user_id").count().agg(F.max("count")).first()[0] == 3


def test_states_expire_by_event_time(spark, tmp_path, fed):
    events, run = fed
    done = ("purchase", "error")
    run(lambda s: state.write_changes(state.expiring_states(s, "user_id", done, 3), str(tmp_path / "out"), str(tmp_path / "seen")))
    got = state.current(spark, str(tmp_path / "out"), "user_id")
    now = events.agg(F.max("ts")).first()[0]
    latest = monitoring.latest_state(events, "user_id")
    want = monitoring.expire_completed(latest, F.lit(now), done, 3)
    assert 0 < want.count() < latest.count()
    assert sorted((r.user_id, r.event_id) for r in got.collect()) == sorted((r.user_id, r.event_id) for r in want.collect())


def test_latest_state_on_a_stream(spark, tmp_path, fed):
    events, run = fed
    run(lambda s: state.write_changes(monitoring.latest_state(s, "user_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "seen")))
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = rows.groupBy("user_id", "event_type").agg(F.max_by("event_id", "batch").alias("event_id"))
    want = monitoring.latest_state(events, "user_id", "event_type")
    assert {tuple(r) for r in last.collect()} == {(r.user_id, r.event_type, r.event_id) for r in want.collect()}


def test_sliding_ratings_on_a_stream(spark, tmp_path, fed):
    events, run = fed
    make = lambda e, late=None: monitoring.windowed_rating(e, 7, 50, 52.0, slide=1, late=late)
    run(lambda s: state.write_changes(make(s, "1 day"), str(tmp_path / "out"), str(tmp_path / "seen")))
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = rows.groupBy("start").agg(F.max_by(F.struct("n", "retrain"), "batch").alias("r")).select("start", "r.*")
    want = make(events)
    assert {tuple(r) for r in last.collect()} == {(r.start, r.n, r.retrain) for r in want.collect()}
    low = monitoring.low_rated(events, want, 7, 52.0, slide=1)
    joined = events.join(want.where("retrain"), (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("start") + F.expr("interval 7 days"))).where("value < 52")
    assert {(r.start, r.event_id) for r in low.collect()} == {(r.start, r.event_id) for r in joined.collect()} and low.count() > 0


def _rows(spark, texts, at=0):
    return spark.createDataFrame([(at + k, t, "", "A good answer.") for k, t in enumerate(texts)], "seq long, instruction string, input string, output string")


def test_a_repeated_batch_leaves_each_row_once(spark, tmp_path):
    path = str(tmp_path / "gate")
    batch = _rows(spark, ["Explain the plan well.", "x", "Explain the plan well."])
    for _ in range(2):
        monitoring.gate_batch(batch, 0, path)
    assert spark.read.parquet(path).count() == 3
    assert spark.read.parquet(path).where("accepted").count() == gates.gate(batch).where("accepted").count()


def test_generation_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "accepted")
    first = _rows(spark, ["Explain the long plan well.", "Name three rivers of the north.", "x"])
    second = _rows(spark, ["Explain the long plan well.", "Sort the numbers of this row.", "Say what a prime number is.", "Tell how a bridge is built."], 10)
    for _ in range(2):  # the second time Spark repeats both batches
        monitoring.accept_batch(first, 0, path, target=4)
        monitoring.accept_batch(second, 1, path, target=4)
    got = sorted(r.seq for r in spark.read.parquet(path).collect())
    assert got == [0, 1, 11, 12]
    source = str(tmp_path / "in")
    first.coalesce(1).write.parquet(source)
    for _ in range(2):
        monitoring.generation_stream(spark.readStream.schema(first.schema).parquet(source), str(tmp_path / "s"), str(tmp_path / "seen"))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [0, 1]
