"""Write path and storage of the memory engine, clusters of near-equal rows, and report grammars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.columns import content_hash, dot, jaccard, pick, space_tokens, strip_private, tokens
from . import dense, graph
from .memory import title_members, title_pairs

VERSION = 1


def save_batch(store: DataFrame, candidates: DataFrame, now: int) -> DataFrame:
    """Rows of candidates (id, type, title, content, project_root) to append: private spans stripped, blanks and rows whose hash the store or an earlier candidate of the project has are dropped; immunity and expiry by type."""
    clean = candidates.withColumn("content", strip_private(F.col("content"))).withColumn("content_hash", content_hash(F.col("content")))
    clean = clean.where("content_hash IS NOT NULL AND content <> '[PRIVATE]'")
    first = clean.groupBy("project_root", "content_hash").agg(F.min("id").alias("id"))
    clean = clean.join(first, ["project_root", "content_hash", "id"])
    known = store.select("project_root", content_hash(F.col("content")).alias("content_hash")).where("content_hash IS NOT NULL").distinct()
    new = clean.join(known, ["project_root", "content_hash"], "left_anti")
    ttl = pick(F.col("type"), rules.TTL_DAYS)
    return new.select("id", "type", "project_root", "title", "content", F.col("type").isin(*rules.IMMUNE_TYPES).alias("decay_immune"), (F.lit(now) + ttl * rules.DAY).alias("expires_at_epoch"))


def update(store: DataFrame, changes: DataFrame, columns: list[str], nulls: bool = False) -> DataFrame:
    """Copy on write: store with the columns of changes (id, ...) in place, one row an id; a null in changes keeps the value, or with nulls replaces it. Changes of ids that the store lacks, or of no id, change nothing."""
    c = changes.select(F.col("id").alias("__of"), *[F.col(x).alias(f"__{x}") for x in columns])
    new = lambda x: F.when(F.col("__of").isNotNull() & (F.lit(nulls) | F.col(f"__{x}").isNotNull()), F.col(f"__{x}")).otherwise(F.col(x)).alias(x)
    return store.join(c, F.col("id") == F.col("__of"), "left").select([new(x) if x in columns else F.col(x) for x in store.columns])


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet, and the format's version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def read_snapshot(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables, or None if the version is another."""
    if spark.read.parquet(f"{folder}/meta").first()["version"] != VERSION:
        return None
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def import_json(spark: SparkSession, folder: str, schema: str, store: DataFrame) -> DataFrame:
    """Rows of an export that the store lacks, by content hash."""
    raw = spark.read.schema(schema).json(folder).withColumn("__h", content_hash(F.col("content")))
    return raw.join(store.select(content_hash(F.col("content")).alias("__h")).where("__h IS NOT NULL").distinct(), "__h", "left_anti").drop("__h")


def front_matter(files: DataFrame) -> DataFrame:
    """(path, type, title, body) of Markdown files (path, text) with a header between --- lines."""
    head = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n?", 1)
    fields = F.str_to_map(head, F.lit("\n"), F.lit(":"))
    return files.select("path", F.coalesce(F.trim(F.try_element_at(fields, F.lit("type"))), F.lit("note")).alias("type"), F.trim(F.try_element_at(fields, F.lit("name"))).alias("title"), F.regexp_replace(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n?", ""), r"^\s+|\s+$", "").alias("body"))


def vector_clusters(vectors: DataFrame, least: float = 0.9, bits: int = 6, tables: int = 8, singles: bool = False) -> DataFrame:
    """(id, cluster) of rows (id, embedding) joined by pairs of cosine least or more, and with singles every other row as its own cluster. All pairs are compared, block by block (bits and tables are no longer used)."""
    found = graph.components(graph.cut(dense.near(vectors, least))).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    if not singles:
        return found
    return vectors.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def title_clusters(rows: DataFrame, threshold: float = 0.4, least: int = 3) -> DataFrame:
    """(id, cluster) of single-link clusters of least titles or more; rows of equal titles are members of their own."""
    pairs = title_pairs(rows, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    linked = graph.components(pairs).select(F.col("node").alias("representative"), "component")
    members = title_members(rows).join(linked, "representative", "left").select("id", F.coalesce("component", "representative").alias("cluster"))
    large = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return members.join(large, "cluster").select("id", "cluster")


def distill(rows: DataFrame, clusters: DataFrame, share: float = 0.7) -> DataFrame:
    """(cluster, members, tokens): what at least share of a cluster's titles have in common, at most 20 tokens."""
    t = clusters.join(rows, "id").select("cluster", "id", F.explode(space_tokens(F.col("title"))).alias("token"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    common = t.groupBy("cluster", "token").agg(F.count("*").alias("n")).join(size, "cluster").where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("members") * share)))
    return common.groupBy("cluster", "members").agg(F.array_join(F.slice(F.array_sort(F.collect_list("token")), 1, 20), " ").alias("tokens"))


def goal_search(chains: DataFrame, goal: str, least: float = 0.3) -> DataFrame:
    """(id, similarity) of chains (id, goal) by token Jaccard."""
    wanted = F.array_distinct(tokens(F.lit(goal)))
    return chains.select("id", F.round(jaccard(F.array_distinct(tokens(F.col("goal"))), wanted), 6).alias("similarity")).where(F.col("similarity") >= least)


def symbol_value(query: str, distance: Column, recency_days: Column, accesses: Column, name: Column) -> Column:
    wanted = F.array_distinct(tokens(F.lit(query), "[a-z0-9]+"))
    own = F.array_distinct(tokens(name, "[a-z0-9]+"))
    return F.round(0.35 * jaccard(own, wanted) + 0.30 / (1 + distance) + 0.20 / (1 + recency_days / 30) + 0.15 * F.least(accesses / 10, F.lit(1.0)), 6)


def stats_history(flushes: DataFrame, keep: int = 200) -> DataFrame:
    """Totals over the last keep snapshots of each project, the newest of each session counted."""
    newest = flushes.groupBy("project", "session").agg(F.max_by(F.struct("ts", "chars"), "ts").alias("s")).select("project", "session", "s.*")
    recent = newest.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("ts"), "session"))).where(F.col("k") <= keep)
    return recent.groupBy("project").agg(F.count("*").alias("sessions"), F.sum("chars").alias("chars"))


def compact(rows: DataFrame, least: int = 5) -> DataFrame:
    """(line) of symbol rows (name, type, path, start_line): @S name @T type @P path @L line; a type that all of least rows share is left to the header."""
    every = Window.partitionBy(F.lit(1))
    hoisted = (F.size(F.collect_set("type").over(every)) == 1) & (F.count("*").over(every) >= least)
    return rows.select(F.concat_ws(" ", F.concat(F.lit("@S"), "name"), F.when(~hoisted, F.concat(F.lit("@T"), "type")), F.concat(F.lit("@P"), "path"), F.concat(F.lit("@L"), F.col("start_line").cast("string"))).alias("line"))


def session_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) between two sets of injected ids."""
    gone = before.select("id").distinct().join(after, "id", "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(after.select("id").distinct().join(before, "id", "left_anti").withColumn("change", F.lit("added")))
