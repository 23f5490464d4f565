"""Queries of the graph operators over a graph that the driver's tables give, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import communities as K
from ..operators import graph as G
from ..operators import relevance as R
from ..operators import sequence as Q
from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


#: A symbol depends on the next one if it follows so often.
THETA = 2


def edges(spark, d):
    """The dependency graph of SURVEY §7.3 from whole tables: symbols to next symbols of a user (node 3k), and suppliers (3k + 1) to their parts (3k + 2)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).withColumn("next", F.lead("k").over(w))
    symbols = e.where("k IS NOT NULL AND next IS NOT NULL").groupBy("k", "next").agg(F.count("*").alias("n")).where(F.col("n") >= THETA)
    parts = table(spark, d, "lineitem").select((3 * F.col("l_suppkey") + 1).alias("src"), (3 * F.col("l_partkey") + 2).alias("dst")).distinct()
    return symbols.select((3 * F.col("k")).alias("src"), (3 * F.col("next")).alias("dst")).unionByName(parts)


def one(spark, node):
    return spark.createDataFrame([(node,)], "node long")


_E = """ev AS (SELECT k, lead(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM (SELECT user_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
ed AS MATERIALIZED (SELECT 3 * k AS src, 3 * next AS dst FROM ev WHERE k IS NOT NULL AND next IS NOT NULL GROUP BY k, next HAVING count(*) >= 2 UNION ALL SELECT DISTINCT 3 * l_suppkey + 1, 3 * l_partkey + 2 FROM lineitem)"""
_BFS = "WITH RECURSIVE {e}, r(node, depth) USING KEY (node) AS (SELECT {s}::BIGINT, 0 UNION SELECT {b}, min(depth) + 1 FROM r JOIN ed ON {a} = node WHERE src <> dst AND {b} NOT IN (SELECT node FROM recurring.r) GROUP BY {b})"
add("dependencies_bfs", lambda s, d: G.bfs(edges(s, d), one(s, 36)).select("node", "depth"), _BFS.format(e=_E, s=36, a="src", b="dst") + " SELECT node, depth FROM r")
add("change_impact", lambda s, d: G.change_impact(edges(s, d), one(s, 5)), _BFS.format(e=_E, s=5, a="dst", b="src") + " SELECT node, depth, round(greatest(0.05::DOUBLE, pow(0.6::DOUBLE, depth - 1)), 6) AS confidence FROM r WHERE depth > 0")
add("call_chain", lambda s, d: G.call_chain(edges(s, d), one(s, 36), 297),
    f"""WITH RECURSIVE {_E}, r(node, depth, parent) USING KEY (node) AS (SELECT 36::BIGINT, 0, NULL::BIGINT UNION
    SELECT dst, min(depth) + 1, min(src) FROM r JOIN ed ON src = node WHERE src <> dst AND dst NOT IN (SELECT node FROM recurring.r) GROUP BY dst),
    p(step, node, parent) AS (SELECT depth, node, parent FROM r WHERE node = 297 UNION ALL SELECT r.depth, r.node, r.parent FROM p JOIN r ON r.node = p.parent) SELECT step, node FROM p""")
add("graph_components", lambda s, d: G.components(edges(s, d)),
    f"""WITH RECURSIVE {_E}, b AS MATERIALIZED (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), r(node, component) USING KEY (node) AS (SELECT src, min(src) FROM b GROUP BY 1 UNION
    SELECT b.dst, min(r.component) FROM r JOIN b ON b.src = r.node JOIN recurring.r o ON o.node = b.dst WHERE r.component < o.component GROUP BY 1) SELECT node, component FROM r""")
add("import_cycles", lambda s, d: G.cycles(edges(s, d), loops=True),
    f"""WITH RECURSIVE {_E}, n AS MATERIALIZED (SELECT src, dst FROM ed WHERE src <> dst AND dst IN (SELECT src FROM ed) AND src IN (SELECT dst FROM ed)), r(a, b) AS (SELECT src, dst FROM n UNION SELECT r.a, n.dst FROM r JOIN n ON n.src = r.b),
    c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT * FROM c UNION ALL SELECT DISTINCT src, src FROM ed WHERE src = dst AND src NOT IN (SELECT node FROM c)""")
_RW = f"WITH {_E}, nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), dg AS (SELECT src, count(*) AS d FROM ed GROUP BY 1), s0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS score FROM nd)" + "".join(
    f", s{i + 1} AS MATERIALIZED (SELECT node, coalesce(f, 0) + CASE WHEN node = 3 THEN 0.15 ELSE 0 END::DOUBLE AS score FROM nd LEFT JOIN (SELECT dst, sum(0.85::DOUBLE * score / d) AS f FROM ed JOIN dg USING (src) JOIN s{i} ON node = src GROUP BY 1) ON dst = node)" for i in range(10))
add("random_walk", lambda s, d: G.random_walk(edges(s, d), 3), _RW + " SELECT node, round(score, 6) AS score FROM s10")
_LP = f"WITH {_E}, b AS MATERIALIZED (SELECT src, dst FROM ed WHERE src <> dst UNION SELECT dst, src FROM ed WHERE src <> dst), l0 AS (SELECT DISTINCT src AS node, src AS label FROM b)" + "".join(
    f", l{i + 1} AS MATERIALIZED (SELECT node, arg_max(label, n * 1000000000 - label) AS label FROM (SELECT src AS node, label, count(*) AS n FROM b JOIN l{i} ON node = dst GROUP BY ALL) GROUP BY 1)" for i in range(5))
add("label_propagation", lambda s, d: G.label_propagation(G.cut(edges(s, d))), _LP + " SELECT * FROM l5")


def modularity(s, d):
    e = G.cut(edges(s, d))
    return G.modularity(e, G.label_propagation(e))


add("modularity", modularity, _LP + ", m AS (SELECT count(*)::DOUBLE AS m2 FROM b) SELECT x.label, round(count(*) FILTER (x.label = y.label) / any_value(m2) - pow(count(*) / any_value(m2), 2), 6) + 0.0::DOUBLE AS q FROM b JOIN l5 x ON x.node = src JOIN l5 y ON y.node = dst, m GROUP BY 1")
add("dependents_budget", lambda s, d: G.dependents(edges(s, d), 5, 20), f"WITH {_E} SELECT * FROM (SELECT src, sum(length(src::VARCHAR)) OVER (ORDER BY src)::BIGINT AS chars FROM ed WHERE dst = 5) WHERE chars <= 20")
add("degrees", lambda s, d: G.degrees(edges(s, d)), f"WITH {_E} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, 1 FROM ed) GROUP BY 1")
add("reverse_graph", lambda s, d: G.reverse(edges(s, d)), f"WITH {_E} SELECT dst AS src, src AS dst FROM ed")


def symbol_edges(spark, d):
    """The part of edges() between symbols."""
    return edges(spark, d).where("src % 3 = 0 AND dst % 3 = 0")


def communities(s, d):
    return K.named(K.local_moving(G.cut(edges(s, d))))


def community_lookup(s, d):
    """For every symbol whose number 50 divides, its community in the graph of symbols."""
    state = G.cut(K.named(K.local_moving(G.cut(symbol_edges(s, d)))))
    return K.members(state, state.where("node % 150 = 0"))


add("communities", communities)
add("community_lookup", community_lookup)


def seeds(e):
    """Every node whose number 50 divides."""
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().where("node % 50 = 0")


def relevance_walks(s, d):
    """Scores of the walks from all of them, with the certified bound of each."""
    e = G.cut(edges(s, d))
    return R.walks(e.unionByName(G.reverse(e)), seeds(e)).select("seed", "node", F.round("score", 6).alias("score"), F.round("bound", 6).alias("bound"))


def relevance_cluster(s, d):
    e = G.cut(edges(s, d))
    log = table(s, d, "events").select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("long").alias("symbol")).where("symbol IS NOT NULL")
    together = Q.npmi(log).select((3 * F.col("a")).alias("a"), (3 * F.col("b")).alias("b"), "npmi")
    return R.cluster(e, seeds(e), together)


add("relevance_walks", relevance_walks)
add("relevance_cluster", relevance_cluster)
