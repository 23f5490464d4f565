"""The streaming twin gives the batch rows of all windows that the watermark has closed."""

import shutil

from pyspark.sql import functions as F

from quillmine.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_session_windows_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    E.run_available(E.session_windows(E.stream_calls(spark, str(tmp_path / "in"), batch.schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in E.session_windows(batch.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"))).collect()}
    assert got and got <= whole and len(whole - got) <= 5
