"""The click and query counters as streams, and windows over clicks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.constants import LONG_CLICK_SECONDS
from ..operators.feedback import click_counts, query_counts
from ..scratch import folder
from ..sources.store import Store

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A file stream of events; ts becomes a timestamp with zone, which watermarks need."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def count_clicks(clicks: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """ST1: each batch's counts are merged into the table under (query, url). The last batch merged
    is kept with the counters, so a batch that runs again is not counted twice."""
    return _merge(clicks, click_counts, store, table, checkpoint, ["query", "url"], ["short_clicks", "long_clicks"])


def count_queries(log: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """ST2."""
    return _merge(log, query_counts, store, table, checkpoint, ["query"], ["search_count"])


def _merge(rows, count, store, table, checkpoint, keys, counts) -> StreamingQuery:
    def batch(df: DataFrame, epoch: int) -> None:
        number, manifest = store.state(table)
        if manifest.get("meta", {}).get("epoch", -1) >= epoch:
            return
        new = count(df)
        if manifest:
            # only the counters that this batch touches are read and written
            old = store.read(table).join(new.select(*keys), keys, "left_semi")
            new = old.select(*keys, *counts).unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
        store.upsert(table, new, keys, meta={"epoch": epoch}, base=number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """ST4, ST5: an append-only JSON sink."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


TICK_MS = 60_000


class LongClicks(StatefulProcessor):
    """ST3. A user's events wait until the watermark has passed their minute, so that they are taken in
    order however they arrive; then each is told long or short by the next one. The last event taken is
    held: if the watermark gets ``idle`` seconds past it (to the next full minute) without another, it
    is short and the user's state ends. An event that comes after such a pause begins anew. Events
    behind the watermark are dropped by the watermark's rule. A user has one state value, which holds
    what the watermark hasn't passed, and one timer that matters, for whatever is due next."""

    def __init__(self, seconds: int, idle: int):
        self.seconds, self.idle = seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.user = handle.getValueState("user", "us array<long>, event_id array<long>, held_us long, held_id long")

    @staticmethod
    def _due(us: int) -> int:
        """The end of the event's minute, in milliseconds."""
        return (us // (TICK_MS * 1000) + 1) * TICK_MS

    def _state(self) -> tuple[list, tuple | None]:
        us, events, held_us, held_id = self.user.get() if self.user.exists() else ([], [], None, None)
        return list(zip(us, events)), None if held_id is None else (held_us, held_id)

    def _keep(self, waiting: list, held: tuple | None) -> None:
        if not waiting and held is None:
            self.user.clear()
            return
        self.user.update(([w[0] for w in waiting], [w[1] for w in waiting], *(held or (None, None))))
        ends = [self._due(waiting[0][0])] if waiting else []
        self.handle.registerTimer(min([*ends, *([self._due(held[0] + self.idle * 1_000_000)] if held else [])]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, held = self._state()
        for batch in rows:
            us = batch["ts"].dt.tz_localize(None) if batch["ts"].dt.tz is not None else batch["ts"]
            waiting += zip(us.astype("datetime64[us]").astype("int64").tolist(), batch["event_id"].tolist())
        self._keep(sorted(waiting), held)
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "kind": pd.Series(dtype="str")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, held = self._state()
        said, taken = [], 0
        for us, event in waiting:
            if self._due(us) > now:
                break
            if held is not None:
                long = self.seconds * 1_000_000 < us - held[0] <= self.idle * 1_000_000
                said.append((key[0], held[1], "long_click" if long else "short_click"))
            held, taken = (us, event), taken + 1
        if held is not None and self._due(held[0] + self.idle * 1_000_000) <= now:
            said.append((key[0], held[1], "short_click"))
            held = None
        self._keep(waiting[taken:], held)
        yield pd.DataFrame(said, columns=["user_id", "event_id", "kind"])

    def close(self) -> None:
        pass


def long_clicks(events: DataFrame, seconds: int = LONG_CLICK_SECONDS, late: str = "10 minutes", idle: int = 1800) -> DataFrame:
    """ST3: user_id, event_id, kind of every event, once it is known. idle: more than ``seconds``."""
    # timers and states of several variables need this kind of state store
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(LongClicks(seconds, idle), "user_id long, event_id long, kind string", "Append", "EventTime")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``. Repeats of an event within the
    watermark count once; a session is put out when the watermark has passed its end."""
    rows = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def window_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events by event-time window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def all_window_counts(events: DataFrame, path: str, window: str = "1 hour") -> DataFrame:
    """The same of all events, however late and with the windows that are still open: each batch writes its own counts,
    a batch that runs again over its first ones, and the sums are read."""

    def batch(df: DataFrame, epoch: int) -> None:
        counts = df.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
        counts.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    events.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = events.sparkSession
    rows = spark.read.schema("start timestamp, event_type string, n long, epoch long").parquet(f"{path}/rows")
    return rows.groupBy("start", "event_type").agg(F.sum("n").alias("n"))


def to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only Parquet sink; the files of a batch count only once the batch is committed."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_to_files(rows: DataFrame) -> DataFrame:
    """Run a stream over what there is, in a folder that goes with the application, and read its sink."""
    path = folder(rows.sparkSession, "stream")
    to_files(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
