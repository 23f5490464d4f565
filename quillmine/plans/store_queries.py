"""Queries of the write path, clusters and report grammars, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distillation as D
from ..operators import memory as M
from ..operators import store as W
from .bindings import NOW, OBS, observations, table
from .code_queries import py, values
from .memory_queries import HASH

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, columns: str | None = None, rows: list[tuple] | None = None, sql: str | None = None) -> None:
    QUERIES[name] = query
    if rows or sql:
        ORACLES[name] = sql or values(columns, rows)


def save(s, d):
    o = observations(s, d)
    return W.save_batch(o.where("id % 2 = 0"), o.where("id % 2 = 1"), NOW).select("id", "type", "decay_immune", "expires_at_epoch")


add("save_observations", save, sql=f"""WITH {OBS}, h AS (SELECT *, {HASH} AS h FROM obs), n AS (SELECT *, row_number() OVER (PARTITION BY project_root, h ORDER BY id) AS k FROM h WHERE id % 2 = 1 AND h IS NOT NULL)
SELECT id, type, decay_immune, expires_at_epoch - created_at_epoch + {NOW} AS expires_at_epoch FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM h s WHERE s.id % 2 = 0 AND s.project_root = n.project_root AND s.h = n.h)""")
add("update_observations", lambda s, d: W.update(observations(s, d).select("id", "importance", "symbol"), observations(s, d).where("id % 3 = 0").select("id", F.lit(9).cast("long").alias("importance"), F.lit(None).cast("string").alias("symbol")), ["importance", "symbol"]),
    sql=f"WITH {OBS} SELECT id, CASE WHEN id % 3 = 0 THEN 9 ELSE importance END AS importance, symbol FROM obs")
add("clear_observations", lambda s, d: W.update(observations(s, d).select("id", "importance", "title"), observations(s, d).where("id % 3 = 0").select("id", F.lit(9).cast("long").alias("importance"), F.lit(None).cast("string").alias("title")), ["importance", "title"], nulls=True),
    sql=f"WITH {OBS} SELECT id, CASE WHEN id % 3 = 0 THEN 9 ELSE importance END AS importance, CASE WHEN id % 3 <> 0 THEN title END AS title FROM obs")
add("front_matter", lambda s, d: W.front_matter(s.createDataFrame([("a.md", "---\ntype: warning\nname: Be careful\n---\nBody\n"), ("b.md", "plain")], "path string, text string")).select("path", "type", F.coalesce("title", F.lit("")).alias("title"), "body"), "path, type, title, body", [("a.md", "warning", "Be careful", "Body"), ("b.md", "note", "", "plain")])
add("title_clusters", lambda s, d: W.title_clusters(observations(s, d).select("id", "title"), 0.7, 2))
add("distill", lambda s, d: W.distill(s.createDataFrame([(1, "never commit secrets a"), (2, "never commit secrets b"), (3, "never commit secrets c")], "id long, title string"), s.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, cluster long")), "cluster, members, tokens", [(1, 3, "commit never secrets")])
add("vector_clusters", lambda s, d: W.vector_clusters(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), singles=True))
add("reasoning_search", lambda s, d: W.goal_search(observations(s, d).select("id", F.col("title").alias("goal")), "the the for of and that thion", 0.05), sql=f"""WITH {OBS}, t AS (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9_]{{3,}}')) AS t, ['the', 'for', 'and', 'that', 'thion'] AS q FROM obs)
SELECT * FROM (SELECT id, round(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))), 6) AS similarity FROM t WHERE len(t) > 0) WHERE similarity >= 0.05""")
add("symbol_value", lambda s, d: observations(s, d).select("id", W.symbol_value("the for", F.col("id") % 5, (F.lit(NOW) - F.col("created_at_epoch")) / 86400, F.col("access_count"), F.col("title")).alias("value")), sql=f"""WITH {OBS}, t AS (SELECT *, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t, ['the', 'for'] AS q FROM obs)
SELECT id, round(0.35 * CASE WHEN len(t) = 0 THEN 0 ELSE len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) END + 0.30 / (1 + id % 5) + 0.20 / (1 + (({NOW} - created_at_epoch) / 86400) / 30) + 0.15 * least(access_count / 10, 1.0), 6)::DOUBLE AS value FROM t""")
add("stats_flush", lambda s, d: W.stats_history(table(s, d, "conversations").select(F.col("role").alias("project"), F.col("conv_id").alias("session"), F.col("turn").alias("ts"), F.length("text").alias("chars"))), sql="WITH n AS (SELECT role, conv_id, arg_max(length(text), turn) AS c, max(turn) AS t FROM conversations GROUP BY role, conv_id), k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY t DESC, conv_id) AS k FROM n) SELECT role AS project, count(*) AS sessions, sum(c)::BIGINT AS chars FROM k WHERE k <= 200 GROUP BY 1")
add("output_compact", lambda s, d: W.compact(py(s).where("kind = 'function'").select(F.col("qualified_name").alias("name"), F.col("kind").alias("type"), "path", "start_line")), "line", [("@Sf @Tfunction @Papp.py @L4",), ("@Sg @Tfunction @Papp.py @L8",), ("@Sc @Tfunction @Psrc/lib/util.py @L3",), ("@Stest_c @Tfunction @Psrc/lib/util.py @L7",)])
add("session_delta", lambda s, d: W.session_delta(s.createDataFrame([(1,), (2,)], "id long"), s.createDataFrame([(2,), (3,)], "id long")), "id, change", [(1, "removed"), (3, "added")])


def kinds(s, d):
    return observations(s, d).select("id", F.col("type").alias("kind"), "title")


def mdl_distill(s, d):
    """Members of the clusters of like titles that an abstraction shortens by a fifth or more, with their deltas."""
    rows = kinds(s, d)
    chosen = D.accepted(D.distilled(rows, D.cut(D.clusters(rows))))
    return chosen.select("id", "cluster", "delta", "abstraction", "members", F.col("before").alias("chars_before"), F.col("after").alias("chars_after"), "compression")


def mdl_links(s, d):
    """The table after distillation, in figures: rows, rewritten members, abstractions, links, and characters of all titles."""
    rows = kinds(s, d)
    chosen = D.cut(D.accepted(D.distilled(rows, D.cut(D.clusters(rows)))))
    kept, links = D.applied(rows, chosen)
    n = kept.agg(F.count("*").alias("n_rows"), F.count_if(F.col("title").startswith("[delta] ")).alias("rewritten"), F.count_if(F.col("id") < 0).alias("abstractions"), F.sum(F.length("title")).alias("chars"))
    return n.crossJoin(links.agg(F.count("*").alias("n_links")))  # one row each


_MDL = f"""WITH RECURSIVE {OBS}, t AS MATERIALIZED (SELECT id, type AS kind, title, list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '[ \t\n\r\f]+'), lambda x: x <> '')) AS w FROM obs),
p AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.kind = b.kind AND a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0
      WHERE round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 6) >= 0.4),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS cluster FROM r GROUP BY id), held AS MATERIALIZED (SELECT cluster, id, kind, title FROM m JOIN t USING (id) QUALIFY count(*) OVER (PARTITION BY cluster) >= 3),
sz AS (SELECT cluster, count(*) AS members, sum(length(title))::BIGINT AS before, min(kind) AS kind FROM held GROUP BY 1),
sp AS (SELECT cluster, id, unnest(string_split(title, ' ')) AS piece, generate_subscripts(string_split(title, ' '), 1) AS spot FROM held),
cn AS (SELECT cluster, piece, count(DISTINCT id) AS n FROM sp WHERE length(piece) > 2 GROUP BY ALL),
cm AS MATERIALIZED (SELECT cluster, piece, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, piece) - 1 AS number FROM cn JOIN sz USING (cluster) WHERE n >= members * 0.7::DOUBLE QUALIFY number < 20),
hd AS (SELECT cluster, '[MDL:' || any_value(kind) || '] ' || coalesce(string_agg(piece, ' ' ORDER BY number), '') AS abstraction FROM sz LEFT JOIN cm USING (cluster) GROUP BY cluster),
dl AS (SELECT cluster, id, string_agg(CASE WHEN number IS NOT NULL THEN '@' || number WHEN piece[1] IN ('@', chr(92)) THEN chr(92) || piece ELSE piece END, ' ' ORDER BY spot) AS delta FROM sp LEFT JOIN cm USING (cluster, piece) GROUP BY ALL),
tot AS (SELECT cluster, sum(length(delta))::BIGINT + any_value(length(abstraction)) AS after FROM dl JOIN hd USING (cluster) GROUP BY cluster),
fin AS (SELECT id, cluster, delta, abstraction, members, before AS chars_before, after AS chars_after, round((before - after) / before::DOUBLE, 4) AS compression FROM dl JOIN hd USING (cluster) JOIN sz USING (cluster) JOIN tot USING (cluster) WHERE (before - after) / before::DOUBLE >= 0.2)"""
add("mdl_distill", mdl_distill, sql=_MDL + " SELECT * FROM fin")
add("mdl_links", mdl_links, sql=_MDL + """, heads AS (SELECT DISTINCT cluster, abstraction FROM fin), k AS (SELECT title FROM t WHERE id NOT IN (SELECT id FROM fin) UNION ALL SELECT '[delta] ' || delta FROM fin UNION ALL SELECT abstraction FROM heads)
SELECT (SELECT count(*) FROM k) AS n_rows, (SELECT count(*) FROM k WHERE title LIKE '[delta] %') AS rewritten, (SELECT count(*) FROM heads) AS abstractions, (SELECT sum(length(title))::BIGINT FROM k) AS chars, (SELECT count(*) FROM fin) AS n_links""")
