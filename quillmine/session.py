"""Spark session defaults shared by tests, the bench and command lines."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "quillmine", **conf: str) -> SparkSession:
    """A local session in UTC with AQE on. On a cluster, build the session yourself: no operator depends on this one."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.executorEnv.PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep),
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def attach(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it is not installed. Local sessions inherit the driver's path instead."""
    import tempfile
    import zipfile

    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:  # the driver's own; addPyFile copies the file to the executors
        name = f"{folder}/{root.name}.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in root.rglob("*.py"):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
