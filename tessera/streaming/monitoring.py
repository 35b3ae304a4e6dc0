"""Activity logs and status, as streams and as tables (event_id, ts, key columns).

The reference has no event time handling; the watermark here is an addition of ours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.gates import diversity, gate


def recent(log: DataFrame, most: int, condition: Column | None = None) -> DataFrame:
    """The newest rows, ties by the larger event_id."""
    return (log if condition is None else log.where(condition)).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def latest_state(events: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key; the same on a table and, in update mode, on a stream."""
    rest = [c for c in events.columns if c not in keys and c not in ("ts", "event_id")]
    return events.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", *rest)).alias("s")).select(*keys, "s.*")


def history(events: DataFrame, key: str, most: int = 100) -> DataFrame:
    """The newest `most` rows of each key with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return tokens / F.greatest(seconds, F.lit(0.001))


def progress(events: DataFrame, key: str, total: int) -> DataFrame:
    """(key, done, elapsed, rate, eta): rows a second since the first one, and the seconds that the rest takes; null without a rate."""
    agg = events.groupBy(key).agg(F.count("*").alias("done"), (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("elapsed"))
    rated = agg.withColumn("rate", F.col("done") / F.greatest(F.col("elapsed"), F.lit(1.0)))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return rated.withColumn("eta", F.when(F.col("rate") > 0, left / F.greatest(F.col("rate"), F.lit(0.001))))


def expire_completed(states: DataFrame, now: Column, done: tuple[str, ...], hours: int = 24) -> DataFrame:
    """States but those done (by event_type) and older than `hours`."""
    old = F.col("ts") < now - F.expr(f"INTERVAL {hours} HOURS")
    return states.where(~(F.col("event_type").isin(*done) & old))


def merge_metrics(updates: DataFrame, key: str) -> DataFrame:
    """(key, metric, value): the latest value of each metric of each key, from updates (key, ts, event_id, metric, value)."""
    return updates.groupBy(key, "metric").agg(F.max(F.struct("ts", "event_id", "value"))["value"].alias("value"))


def windowed_rating(events: DataFrame, days: int = 7, least: int = 100, below: float = 3.5, slide: int | None = None, late: str | None = None) -> DataFrame:
    """(start, n, average, retrain): windows of days, one every `slide` days (without it, one after the other), and whether their ratings ask for a retraining.

    The same on a table and on a stream; `late` sets the watermark by which a stream's windows close.
    """
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    span = F.window("ts", f"{days} days", f"{slide or days} days").alias("w")
    own = own.groupBy(span).agg(F.count("*").alias("n"), F.avg("value").alias("average"))
    return own.select(F.col("w.start").alias("start"), "n", "average", ((F.col("n") >= least) & (F.col("average") < below)).alias("retrain"))


def low_rated(events: DataFrame, windows: DataFrame, days: int = 7, below: float = 3.5, slide: int | None = None) -> DataFrame:
    """(start, event_id, value): the rows rated below the limit in the windows of windowed_rating that ask for a retraining.

    A row is dealt to the days / slide windows that hold it, which meet the asked ones by equality.
    """
    span = F.window("ts", f"{days} days", f"{slide or days} days")
    own = events.where(F.col("value") < below).select("event_id", "value", span.alias("w")).select(F.col("w.start").alias("start"), "event_id", "value")
    return own.join(windows.where("retrain").select("start"), "start", "left_semi")


def append_log(rows: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Append log rows (event_id, ts, ..) to the Parquet log at path, which is read whole with a column batch; `recent` holds readers to the newest.

    What a stream's source holds now comes in once by its checkpoint: each batch is one folder, which a repeated batch replaces. A
    table is added as it is, each time.
    """
    if not rows.isStreaming:
        rows.write.mode("append").parquet(f"{path}/batch=table")
    else:
        run_available(rows.sparkSession, rows, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))


def run_available(spark: SparkSession, source: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over what its source holds now; each batch goes to `each` with its id, again with the same id after a failure: `each` must replace what it wrote."""
    source.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def gate_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One batch of instruction rows with its checks, as the folder batch_id=<id> below path, which a repeated batch replaces."""
    gate(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stream_quality_gate(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Pass what a stream of instruction rows has now through the gates of a batch, and write it with its checks to path as Parquet, each row once."""
    run_available(rows.sparkSession, rows, checkpoint, lambda batch, n: gate_batch(batch, n, path))


def accept_batch(batch: DataFrame, batch_id: int, path: str, target: int | None = None, last: int = 50) -> None:
    """The rows of a batch that pass the gates and differ from the last rows accepted in earlier batches, as the folder batch_id=<id>.

    What earlier batches accepted is all the state: folders of smaller ids are read, so a repeated batch gives the same rows and replaces
    its folder. Beyond `target` accepted rows nothing more is taken; the rows of the last batch go by seq.
    """
    spark = batch.sparkSession
    rows = gate(batch).where("accepted").select("seq", "instruction", "input", "output")
    shape = rows.schema
    have = 0
    if batch_id > 0:
        before = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in shape.fields)}, batch_id long").parquet(path).where(F.col("batch_id") < batch_id)
        have = before.count()
        rows = diversity(rows, before, last).where("diverse").select(*shape.names)
    if target is not None:
        rows = rows.orderBy("seq").limit(max(0, target - have))
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def generation_stream(rows: DataFrame, path: str, checkpoint: str, target: int | None = None) -> None:
    """The generation loop on a stream of generated rows (seq, instruction, input, output): every micro-batch is one round of accept_batch."""
    run_available(rows.sparkSession, rows, checkpoint, lambda batch, n: accept_batch(batch, n, path, target))
