"""The generic relational checklist over the wide tables, usage views and streaming twins, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming import events as E
from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


add("usage_by_category", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n")),
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem GROUP BY ALL")
add("dashboard_projects", lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.countDistinct("o_custkey").alias("clients"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done")),
    "SELECT c_mktsegment, count(DISTINCT o_custkey) AS clients, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("region_revenue", lambda s, d: table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")),
    "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("semi_join", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
add("anti_join", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("top_per_group", lambda s, d: table(s, d, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("place <= 5").select("o_orderpriority", "o_orderkey", "place"),
    "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 5")
add("session_cache", lambda s, d: table(s, d, "events").withColumn("before", F.lag("props").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).groupBy("event_type").agg(F.count_if(F.col("before") == F.col("props")).alias("repeats"), F.count_if(F.col("before").isNull()).alias("first_reads")),
    "SELECT event_type, count(*) FILTER (before = props) AS repeats, count(*) FILTER (before IS NULL) AS first_reads FROM (SELECT event_type, props, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
add("id_delta", lambda s, d: table(s, d, "labels").select("doc_id").exceptAll(table(s, d, "labels").where("quality = 1").select("doc_id")).intersect(table(s, d, "documents").select("doc_id")), "SELECT doc_id FROM labels WHERE quality <> 1 INTERSECT SELECT doc_id FROM documents")
add("cube_usage", lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
add("naive_cost", lambda s, d: table(s, d, "pages").agg(F.sum(F.length("html")).alias("chars"), F.sum(F.floor(F.length("html") / 4)).alias("tokens"), F.round(F.sum(F.floor(F.length("html") / 4)) * 3e-6, 6).alias("usd")), "SELECT sum(length(html))::BIGINT AS chars, sum(length(html) // 4)::BIGINT AS tokens, round(sum(length(html) // 4)::BIGINT * 3e-6::DOUBLE, 6) AS usd FROM pages")
add("file_links", lambda s, d: table(s, d, "pages").select(F.col("url").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("dst")), """SELECT url AS src, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS dst FROM pages""")
add("file_dependents", lambda s, d: table(s, d, "pages").select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("dst")).groupBy("dst").agg(F.count("*").alias("pages")), """SELECT dst, count(*) AS pages FROM (SELECT url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS dst FROM pages) GROUP BY 1""")
add("session_windows", lambda s, d: E.session_windows(table(s, d, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"))).select("session", F.unix_micros("start").alias("start_us"), "calls"),
    """WITH a AS (SELECT user_id AS session, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
    SELECT session, epoch_us(min(ts)) AS start_us, count(*) AS calls FROM b GROUP BY session, k""")
add("capture_filter", lambda s, d: table(s, d, "documents").where(F.length("text") >= 4096).select(F.col("doc_id").alias("id"), F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("args_hash")), "SELECT doc_id AS id, substr(sha1(text), 1, 16) AS args_hash FROM documents WHERE length(text) >= 4096")
