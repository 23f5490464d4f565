"""Sessions of a call log as keyed state with timers: what each one touched, when it closed, and duplicates within the watermark.

A session is a run of one user's events in which no two neighbours are gap or more apart. State keeps each user's open
sessions; an event that comes out of order opens one, lengthens one or joins two. An event-time timer at the first session's
end plus gap closes it and all others that are over: they leave the state and come out as one row each. The state of a
user is one value that holds what is open, so it is bounded by what gap and watermark let be open at once.

Cases: events behind the watermark are dropped, as their session may be out already; events without a user or a time are
dropped, but a time without a user moves the watermark; without a symbol they count as calls only; an event whose id was
seen within the watermark is dropped (deduplicated()). Times are rounded to whole milliseconds, halves away from zero, as epoch_ms
of the SQL does, before anything is compared. The batch twin, sessions(), gives the rows of a stream that has seen the
same events in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

GAP_MS = 30 * 60 * 1000
DELAY = "10 minutes"
RESULT = "user long, start_ms long, end_ms long, calls long, symbols array<long>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def calls(events: DataFrame) -> DataFrame:
    """(event_id, user, ts, symbol) of an event table, batch or stream, ts in whole milliseconds."""
    symbol = F.get_json_object("props", "$.k").cast("long")
    ms = F.timestamp_millis(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000).cast("decimal(4,0)")).cast("long"))
    return events.select("event_id", F.col("user_id").cast("long").alias("user"), ms.alias("ts"), symbol.alias("symbol"))


def deduplicated(log: DataFrame, delay: str = DELAY) -> DataFrame:
    """A stream of calls() under a watermark of all its times, each event_id once as long as the watermark remembers it; rows without a user or a time are left out."""
    # one condition on both columns, as Spark would filter users alone before the watermark
    whole = ~F.array_contains(F.array(F.col("user").isNull(), F.col("ts").isNull()), True)
    return log.withWatermark("ts", delay).where(whole).dropDuplicatesWithinWatermark(["event_id"])


def sessions(log: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """RESULT of all sessions of a batch of calls()."""
    ms = F.unix_millis("ts")
    w = Window.partitionBy("user").orderBy("ms", "event_id")
    rows = log.where("user IS NOT NULL AND ts IS NOT NULL").select("user", "event_id", "symbol", ms.alias("ms"))
    head = F.coalesce((F.col("ms") - F.lag("ms").over(w) >= gap_ms).cast("int"), F.lit(1))
    rows = rows.withColumn("head", head).withColumn("number", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = rows.groupBy("user", "number").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("calls"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
    return made.drop("number")


def merged(open_: list[tuple], new: list[tuple], gap_ms: int) -> list[tuple]:
    """Sessions (start, end, calls, symbols) with those joined that are less than gap apart."""
    out: list[tuple] = []
    for s in sorted([*open_, *new], key=lambda s: s[:2]):
        if out and s[0] - out[-1][1] < gap_ms:
            last = out[-1]
            out[-1] = (last[0], max(last[1], s[1]), last[2] + s[2], last[3] | s[3])
        else:
            out.append(s)
    return out


class Sessions(StatefulProcessor):
    """Open sessions of one user. One timer, for the first that can close, closes all that the watermark has passed."""

    def __init__(self, gap_ms: int = GAP_MS):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_ms array<long>, end_ms array<long>, calls array<long>, symbols array<array<long>>")

    def _get(self) -> list[tuple]:
        held = self.open.get()
        return [(s, e, n, frozenset(k)) for s, e, n, k in zip(*held)] if held else []

    def _put(self, now: list[tuple]) -> None:
        if now:
            start, end, calls_, symbols = zip(*now)
            self.open.update((list(start), list(end), list(calls_), [sorted(k) for k in symbols]))
        else:
            self.open.clear()

    def _next(self, now: list[tuple]) -> int | None:
        return min(s[1] for s in now) + self.gap_ms if now else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            ms = frame["ts"].to_numpy("datetime64[ms]").astype("int64").tolist()
            new += [(t, t, 1, frozenset() if pd.isna(k) else frozenset((int(k),))) for t, k in zip(ms, frame["symbol"])]
        before = self._get()
        now = merged(before, new, self.gap_ms)
        was, due = self._next(before), self._next(now)
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(due)
        self._put(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed_at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        now = self._get()
        done = [s for s in now if s[1] + self.gap_ms <= closed_at]
        if done:
            left = [s for s in now if s[1] + self.gap_ms > closed_at]
            self._put(left)
            if left:
                self.handle.registerTimer(self._next(left))
            yield pd.DataFrame({"user": [key[0]] * len(done), "start_ms": [s[0] for s in done], "end_ms": [s[1] for s in done], "calls": [s[2] for s in done], "symbols": [sorted(s[3]) for s in done]})

    def close(self) -> None:
        pass


def streamed(log: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """RESULT of the sessions that a stream under a watermark has closed."""
    return log.groupBy("user").transformWithStateInPandas(Sessions(gap_ms), RESULT, "Append", "EventTime")


def read_events(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1000) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())  # a stream reads folders


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what the stream gives for all files that are there now, and end; started again, it goes on from the checkpoint."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
