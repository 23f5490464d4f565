"""How the domain tables are bound to the driver's tables, in Spark and, as OBS, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import pick

NOW = 1706745600
TYPES = ("note", "bugfix", "decision", "warning", "convention", "guardrail", "research", "idea", "command", "ruled_out")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observations; accesses are the events of the user with the document's number."""
    log = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last"))
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id").join(log, "id", "left")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("id") % 10 + 1).cast("int"))
    created = F.lit(NOW) - (F.col("id") * 7919 % 200) * rules.DAY - (F.col("id") % 24) * 3600
    out = d.withColumns({"type": kind, "created_at_epoch": created, "access_count": F.coalesce(F.col("n") % 7, F.lit(0))})
    ttl = pick(F.col("type"), rules.TTL_DAYS)
    return out.select(
        "id", "type", "created_at_epoch", "access_count",
        F.when(F.col("access_count") > 0, F.col("last")).alias("last_accessed_epoch"),
        F.col("type").isin(*rules.IMMUNE_TYPES).alias("decay_immune"),
        (F.col("created_at_epoch") + ttl * rules.DAY).alias("expires_at_epoch"),
        F.lit(False).alias("archived"), F.lit(1.0).alias("relevance_score"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.col("text").alias("content"), F.col("source").alias("project_root"),
        (F.col("id") % 37).alias("session_id"), (F.col("id") % 10 + 1).alias("importance"),
        F.concat(F.lit("sym"), (F.col("id") % 50).cast("string")).alias("symbol"),
        F.concat(F.lit("src/"), "lang", F.lit("/"), "source", F.lit(".py")).alias("file_path"),
    )


_TTL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TTL_DAYS.items())
OBS = f"""log AS (SELECT user_id AS id, count(*) AS n, floor(max(epoch(ts)))::BIGINT AS last FROM events GROUP BY 1),
b AS (SELECT doc_id AS id, text, lang, source, last, {list(TYPES)!r}[doc_id % 10 + 1] AS type, {NOW} - (doc_id * 7919 % 200) * 86400 - (doc_id % 24) * 3600 AS created_at_epoch, coalesce(n % 7, 0) AS access_count FROM documents LEFT JOIN log ON doc_id = id),
obs AS (SELECT id, type, created_at_epoch, access_count, CASE WHEN access_count > 0 THEN last END AS last_accessed_epoch, type IN {rules.IMMUNE_TYPES!r} AS decay_immune,
created_at_epoch + CASE type {_TTL} END * 86400 AS expires_at_epoch, false AS archived, 1.0::DOUBLE AS relevance_score, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, source AS project_root,
id % 37 AS session_id, id % 10 + 1 AS importance, 'sym' || (id % 50) AS symbol, 'src/' || lang || '/' || source || '.py' AS file_path FROM b)"""
