"""Queries of snapshots and of liveness under conditions, over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import liveness as L
from ..operators import snapshots as P
from ..operators.graph import _folder
from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def snapshot_compare(s, d):
    """Orders, and orders after a range of keys has gone, another has a new price and some have come."""
    book = P.Snapshots(s, f"{_folder(s)}/quillmine/snapshots-{uuid.uuid4().hex}")
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    later = rows.where(~key.between(200, 240)).withColumn("o_totalprice", F.when(key.between(700, 720), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    later = later.unionByName(rows.where(key.between(10, 30)).withColumn("o_orderkey", key + 1_000_000_000))
    book.save("before", rows, "o_orderkey")
    book.save("after", later, "o_orderkey")
    price = lambda c: F.get_json_object(c, "$.o_totalprice").cast("double")
    return book.compare("before", "after").select("key", "change", price("before").alias("price_before"), price("after").alias("price_after"))


def rules(s, d):
    """From every order line to the next one of the order: the part of that line (3k + 2) lives if this line's part and that line's supplier (3k + 1) do; a supplier lives if a part does that it follows in an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(s, d, "lineitem").select((3 * F.col("l_partkey") + 2).alias("part"), (3 * F.col("l_suppkey") + 1).alias("supplier"), F.lead("l_partkey").over(w).alias("p"), F.lead("l_suppkey").over(w).alias("q"))
    nexts = lines.where("p IS NOT NULL").select("part", (3 * F.col("p") + 2).alias("next_part"), (3 * F.col("q") + 1).alias("next_supplier"))
    both = nexts.select(F.col("next_part").alias("head"), F.array("part", "next_supplier").alias("body"))
    return both.unionByName(nexts.select(F.col("next_supplier").alias("head"), F.array("part").alias("body"))).distinct()


def liveness(s, d):
    """What lives if the most expensive part does (the smallest of equals), and in which round it comes to life."""
    root = table(s, d, "part").agg(F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("least"))).alias("one")).select((3 * -F.col("one.least") + 2).alias("node"))
    return L.living(rules(s, d), root)


QUERIES |= {"snapshot_compare": snapshot_compare, "dynamic_liveness": liveness}
ORACLES["snapshot_compare"] = """WITH a AS (SELECT o_orderkey AS key, o_totalprice AS price FROM orders),
b AS (SELECT key, CASE WHEN key BETWEEN 700 AND 720 THEN price + 1 ELSE price END AS price FROM a WHERE NOT key BETWEEN 200 AND 240 UNION ALL SELECT key + 1000000000, price FROM a WHERE key BETWEEN 10 AND 30)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, a.price AS price_before, b.price AS price_after
FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.price <> b.price"""
