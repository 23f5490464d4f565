"""Streaming twins of the call log: the batch function runs on each micro-batch or under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_windows(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session, start, calls) of runs of calls without a gap; calls: session, ts (timestamp)."""
    w = F.session_window("ts", gap)
    return calls.groupBy("session", w.alias("w")).agg(F.count("*").alias("calls")).select("session", F.col("w.start").alias("start"), "calls")


def stream_calls(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The event files of a folder as a stream, ts as a timestamp with a watermark of 10 minutes."""
    raw = spark.readStream.schema(schema).parquet(folder)
    return raw.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes")


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Append what is there now to a Parquet folder and end."""
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
