"""Lexical, vector and fused retrieval; regex search in lines and the symbols around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import dot, tokens

K1, B, RRF_K = 1.2, 0.75, 60


def bm25(docs: DataFrame, query: list[str], limit: int | None = None) -> DataFrame:
    """(id, score) of docs (id, text) for query tokens. Only tokens of the query leave the scan of each document; the statistics are one row a term."""
    terms = list(dict.fromkeys(query))
    rows = docs.select("id", tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("dl"), F.explode_outer("t").alias("term"))
    stats = docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    tf = rows.where(F.col("term").isin(terms)).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row for each query term, and one row
    hits = scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(limit) if limit else hits


def knn(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): the k rows of (id, embedding) of largest dot product; unit vectors, so cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.round(dot(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bm25_each(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query, id, score, place): the best limit rows of docs (id, text) for every row of queries (query, text), scored as bm25 does."""
    wanted = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    rows = docs.select("id", tokens(F.col("text")).alias("t"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_dl"))
    tf = rows.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    parts = tf.join(df, "term").crossJoin(F.broadcast(stats)).select("id", "term", part.alias("part"))
    found = parts.join(wanted, "term").groupBy("query", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= limit)


def rrf_each(lists: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """(query, id, score): ranked lists (query, id, place) fused for every query; a query that a list lacks gets nothing from it."""
    both = lists[0].select("query", "id", "place")
    for x in lists[1:]:
        both = both.unionByName(x.select("query", "id", "place"))
    out = both.groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return out.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def rrf(lists: list[DataFrame], k: int = RRF_K, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, score), each already cut to its top rows."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    parts = [x.select("id", rank.alias("place")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame, query: list[str], vector: list[float], limit: int = 20) -> DataFrame:
    return rrf([bm25(docs, query, 2 * limit), knn(vectors, vector, 2 * limit)], limit=limit)


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of files (path, text), counted from 1."""
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def regex_search(files: DataFrame, pattern: str, limit: int = 100, width: int = 160) -> DataFrame:
    """First lines that match, by path and number; long lines are cut."""
    cut = F.when(F.length("line") > width, F.concat(F.substring("line", 1, width), F.lit("…"))).otherwise(F.col("line"))
    return lines(files).where(F.col("line").rlike(pattern)).orderBy("path", "line_no").limit(limit).select("path", "line_no", cut.alias("line"))


def enclosing(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hits (path, line_no) with the narrowest symbol (path, name, start_line, end_line) around each, or null. Path is an equi-key, so the range is a residual."""
    s = symbols.select("path", "name", "start_line", "end_line")
    on = (hits["path"] == s["path"]) & hits["line_no"].between(s["start_line"], s["end_line"])
    out = hits.join(s, on, "left").select(hits["path"], "line_no", "name", "start_line", "end_line")
    best = F.min_by("name", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "name"))
    return out.groupBy("path", "line_no").agg(best.alias("symbol"))


def paragraphs(files: DataFrame) -> DataFrame:
    """Runs of lines between blank lines as symbols (path, name, start_line, end_line)."""
    w = Window.partitionBy("path").orderBy("line_no")
    rows = lines(files).withColumn("part", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(w)).where("trim(line) <> ''")
    return rows.groupBy("path", "part").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).select("path", F.concat(F.lit("part"), F.col("part").cast("string")).alias("name"), "start_line", "end_line")


def prompt_patterns(prompts: DataFrame, least: int = 3, top: int = 30) -> DataFrame:
    """Tokens of four letters or more by the number of prompts (text) that hold them."""
    t = prompts.select(F.explode(F.array_distinct(tokens(F.col("text"), "[a-z]{4,}"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("prompts")).where(F.col("prompts") >= least).orderBy(F.desc("prompts"), "token").limit(top)
