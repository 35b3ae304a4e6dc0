"""Streams with keyed state: the newest rows of each key, and states that expire by event time.

State is kept in RocksDB, so it may outgrow an executor's memory. What a batch changes is written as one folder, named by the
batch and replaced if Spark repeats it; `current` reads each key's last one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.monitoring import run_available

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "at long, id long, body string"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _packed(events: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """key, at (microseconds of ts), id (event_id) and the whole row as JSON; with `late` also ts with a watermark."""
    ts = F.col("ts").cast("timestamp")
    own = events.select(F.col(key).alias("key"), ts.alias("__ts"), F.unix_micros(ts).alias("at"), F.col("event_id").alias("id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]), _JSON).alias("body"))
    own = own.where("key is not null and at is not null")
    return own.drop("__ts") if late is None else own.withWatermark("__ts", late)


def _opened(packed: DataFrame, events: DataFrame, *more: str) -> DataFrame:
    return packed.select(F.from_json("body", events.schema, _JSON).alias("row"), *more).select("row.*", *more)


def _key_type(events: DataFrame, key: str) -> str:
    return events.schema[key].dataType.simpleString()


class _Newest(StatefulProcessor):
    """The newest rows of a key, as a list of bounded length."""

    def __init__(self, most: int, hours: float | None) -> None:
        self.most, self.hours = most, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("newest", _ROW, None if self.hours is None else int(self.hours * 3_600_000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for df in rows:
            held += zip(df["at"].tolist(), df["id"].tolist(), df["body"].tolist(), strict=True)
            held = heapq.nlargest(self.most, held)
        self.rows.put(held)
        yield pd.DataFrame({"key": [key[0]] * len(held), "body": [r[2] for r in held], "rank": range(1, len(held) + 1)})

    def close(self) -> None:
        pass


def history_stream(events: DataFrame, key: str, most: int = 100, idle_hours: float | None = None) -> DataFrame:
    """The newest `most` rows of each key of a stream (event_id, ts, key, ..) with their rank, as `history` gives them for a table.

    Each batch gives the whole present list of every key that got rows (update mode). A key's state never holds more than
    `most` rows; with idle_hours, keys without rows for so long (of processing time) are forgotten. Rows without a key or ts are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    mode = "None" if idle_hours is None else "ProcessingTime"
    out = _packed(events, key).groupBy("key").transformWithStateInPandas(_Newest(most, idle_hours), f"key {_key_type(events, key)}, body string, rank int", "Update", mode)
    return _opened(out, events, "rank")


class _Expiring(StatefulProcessor):
    """The latest row of a key, and a timer while that row says that the key is done."""

    def __init__(self, done: tuple[str, ...], hours: float) -> None:
        self.done, self.wait = done, int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", _ROW + ", done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = tuple(self.state.get()) if self.state.exists() else None
        for df in rows:
            new = max(zip(df["at"].tolist(), df["id"].tolist(), df["body"].tolist(), df["done"].tolist(), strict=True))
            best = new if best is None else max(best, new)
        self.state.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[3]:
            self.handle.registerTimer(best[0] // 1000 + self.wait + 1)
        yield pd.DataFrame({"key": [key[0]], "body": [best[2]], "expired": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            body = tuple(self.state.get())[2]
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "body": [body], "expired": [True]})

    def close(self) -> None:
        pass


def expiring_states(events: DataFrame, key: str, done: tuple[str, ...], hours: float = 24, late: str = "0 seconds") -> DataFrame:
    """The latest row of each key of a stream (event_id, ts, event_type, key, ..) with expired: what `expire_completed` leaves of `latest_state`.

    A key whose latest event_type is one of `done` is dropped, with a last row that says so, when the watermark is more than `hours` past
    that row: an event-time timer, so it needs no further row of the key. A later row takes the timer back. Rows that come more than `late`
    behind the newest one may be dropped by the watermark. State holds one row for each live key.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own = _packed(events, key, late).withColumn("done", F.coalesce(F.get_json_object("body", "$.event_type").isin(*done), F.lit(False)))
    out = own.groupBy("key").transformWithStateInPandas(_Expiring(done, hours), f"key {_key_type(events, key)}, body string, expired boolean", "Update", "EventTime")
    return _opened(out, events, "expired")


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of changes over what its source holds now; each batch is the folder batch=<id>, which a repeated batch replaces."""
    run_available(changes.sparkSession, changes, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), "update")


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Each key's rows of the last batch that changed it; expired keys have none."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    found = rows.join(last, [key, "batch"]).drop("batch")
    return found.where("not expired").drop("expired") if "expired" in rows.columns else found
