"""Queries of the memory engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import memory as M
from .bindings import NOW, OBS, observations, table

CONFIG = [("note", 0.99, 0.1, 0.02), ("bugfix", 0.995, 0.2, 0.03), ("research", 0.98, 0.1, 0.01), ("warning", 0.999, 0.4, 0.05)]


def _case(key: str, values: dict, default: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


AGE = f"(({NOW} - created_at_epoch) / 86400)"
SCORE = f"""round(0.4 * CASE WHEN {AGE} < 1 THEN 1.0 WHEN {AGE} < 7 THEN 0.8 WHEN {AGE} < 30 THEN 0.5 WHEN {AGE} < 90 THEN 0.2 ELSE 0.1 END::DOUBLE
+ 0.3 * CASE WHEN access_count = 0 THEN 0.0 WHEN access_count = 1 THEN 0.3 WHEN access_count < 5 THEN 0.6 ELSE 1.0 END::DOUBLE + 0.3 * {_case('type', rules.TYPE_SCORES, 0.2)}, 3)"""
REASON = f"""CASE WHEN created_at_epoch < {NOW - 90 * 86400} AND coalesce(last_accessed_epoch, 0) < {NOW - 30 * 86400} AND access_count < 3 AND NOT decay_immune THEN 'age'
WHEN expires_at_epoch < {NOW} THEN 'ttl-expired' """ + " ".join(f"WHEN NOT decay_immune AND type = '{k}' AND access_count = 0 AND created_at_epoch < {NOW - d * 86400} THEN 'zero-access {k} >{d}d'" for k, d in rules.ZERO_ACCESS_DAYS.items()) + " END"
ROI = f"""SELECT id, type, round(p, 4) AS p_hit, stored AS tokens_stored, round(200 * p * 30 * f - stored, 3) AS roi FROM (SELECT id, type,
least(1.0, exp(-0.05 * greatest(0.0, ({NOW} - coalesce(last_accessed_epoch, created_at_epoch)) / 86400)) * (1.0 + 0.1 * access_count))::DOUBLE AS p,
CASE WHEN decay_immune THEN greatest({_case('type', rules.ROI_MULTIPLIERS, 1.0)}, 5.0) ELSE {_case('type', rules.ROI_MULTIPLIERS, 1.0)} END AS f,
greatest(1, (length(title) + length(content)) // 4)::BIGINT AS stored FROM obs)"""
HASH = r"CASE WHEN regexp_replace(content, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') <> '' THEN sha256(lower(regexp_replace(content, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g'))) END"
TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(title), '[ \t\n\r\f]+'), lambda t: t <> ''))"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def on_obs(name: str, op, sql: str) -> None:
    add(name, lambda spark, d: op(observations(spark, d)), f"WITH {OBS} {sql}")


on_obs("observation_score", lambda o: o.select("id", M.observation_score(NOW).alias("score")), f"SELECT id, {SCORE} AS score FROM obs")
on_obs("recent_index", lambda o: M.recent_index(o, NOW), f"SELECT id, type, title, created_at_epoch, {SCORE} AS score FROM obs ORDER BY score DESC, created_at_epoch DESC, id LIMIT 30")
on_obs("top_observations", lambda o: M.top_observations(o, NOW), f"SELECT id, access_count, {SCORE} AS score FROM (SELECT * FROM obs ORDER BY access_count DESC, created_at_epoch DESC, id LIMIT 60) ORDER BY score DESC, id LIMIT 20")
add(
    "relevance_decay",
    lambda spark, d: M.relevance_decay(observations(spark, d), spark.createDataFrame(CONFIG, "type string, decay_rate double, min_score double, boost_on_access double"), NOW),
    f"""WITH {OBS}, c(type, r, m, b) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for a, b, c, e in CONFIG)}),
    n AS (SELECT id, relevance_score AS old, greatest(m, least(1.0, pow(r, {AGE}) + b * access_count)) AS s FROM obs JOIN c USING (type))
    SELECT id, round(s, 4) AS relevance_score FROM n WHERE abs(s - old) > 0.001""",
)
on_obs("decay_candidates", lambda o: M.decay_candidates(o, NOW), f"SELECT id, type, {REASON} AS reason FROM obs WHERE {REASON} IS NOT NULL")
on_obs("decay_preview", lambda o: M.archive_preview(o, NOW), f"SELECT {REASON} AS reason, count(*) AS n, min(id) AS first_id FROM obs WHERE {REASON} IS NOT NULL GROUP BY 1")
on_obs("observation_roi", lambda o: M.roi(o, NOW), ROI)
on_obs("roi_stats", lambda o: M.roi_stats(o, NOW), f"SELECT type, count(*) AS n, sum(tokens_stored)::BIGINT AS tokens_stored, floor(sum(round(roi * 1000)::BIGINT)::DOUBLE * 10.0 / count(*) + 0.5) / 10000 AS avg_roi, count(*) FILTER (roi < 0) AS negative FROM ({ROI}) GROUP BY ROLLUP (type)")
on_obs("promotions", lambda o: M.promotions(o, NOW), f"SELECT id, type AS from_type, t AS to_type FROM obs JOIN (VALUES {', '.join(str(r) for r in rules.PROMOTIONS)}) r(k, n, t) ON type = k AND access_count >= n WHERE last_accessed_epoch >= {NOW - 30 * 86400}")
add("validity", lambda spark, d: M.validity(table(spark, d, "labels").select(F.col("doc_id").alias("obs_id"), (F.col("quality") == 1).alias("ok"))),
    """WITH v AS (SELECT doc_id AS obs_id, 2 + count(*) FILTER (quality = 1) AS alpha, 1 + count(*) FILTER (quality <> 1) AS beta FROM labels GROUP BY 1),
    w AS (SELECT *, round(alpha / (alpha + beta), 6) AS validity FROM v) SELECT *, CASE WHEN validity < 0.4 THEN 'quarantine' WHEN validity < 0.6 THEN 'stale-suspected' ELSE 'valid' END AS state FROM w""")
add("consistency_stats", lambda spark, d: M.consistency_stats(observations(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("obs_id"), (F.col("quality") == 1).alias("ok"))),
    """WITH v AS (SELECT doc_id AS obs_id, round((2 + count(*) FILTER (quality = 1)) / (3 + count(*)), 6) AS validity FROM labels GROUP BY 1)
    SELECT CASE WHEN validity < 0.4 THEN 'quarantine' WHEN validity < 0.6 THEN 'stale-suspected' ELSE 'valid' END AS state, count(*) AS n, round(avg(coalesce(validity, 2/3)), 6) AS mean_validity FROM documents LEFT JOIN v ON doc_id = obs_id GROUP BY 1""")
on_obs("continuity", lambda o: M.continuity(o, NOW), f"""SELECT *, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END AS label FROM (SELECT *, 100 * (total - stale) // total AS score FROM
(SELECT project_root, count(*) AS total, count(*) FILTER (coalesce(last_accessed_epoch, created_at_epoch) < {NOW - 30 * 86400} AND NOT decay_immune) AS stale FROM obs GROUP BY 1))""")
on_obs("memory_stats", M.memory_stats, "SELECT type, project_root, count(*) AS n, sum(access_count)::BIGINT AS accesses FROM obs GROUP BY GROUPING SETS ((type), (project_root), ())")
on_obs("hash_duplicates", M.hash_duplicates, f"SELECT h AS content_hash, min(id) AS keep_id, count(*) AS copies FROM (SELECT id, {HASH} AS h FROM obs) WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
on_obs("dedup_sweep", M.dedup_sweep, f"SELECT id, kept_id FROM (SELECT id, min(id) OVER (PARTITION BY project_root, h) AS kept_id FROM (SELECT id, project_root, {HASH} AS h FROM obs) WHERE h IS NOT NULL) WHERE id <> kept_id")
on_obs("title_near_duplicates", M.title_pairs, f"""SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM (SELECT min(id) AS id, t FROM (SELECT id, list_sort({TOK}) AS t FROM obs) WHERE len(t) > 0 GROUP BY t) a
JOIN (SELECT min(id) AS id, t FROM (SELECT id, list_sort({TOK}) AS t FROM obs) WHERE len(t) > 0 GROUP BY t) b ON a.id < b.id AND a.t[1] <= b.t[len(b.t)] AND len(a.t) >= 0.7 * len(b.t) AND len(b.t) >= 0.7 * len(a.t) WHERE len(list_intersect(a.t, b.t)) >= 0.7 * len(list_distinct(list_concat(a.t, b.t)))""")
add("title_near_duplicate_links", lambda spark, d: M.title_links(observations(spark, d).select("id", "title")))
on_obs("timeline", lambda o: M.timeline(o, 42, 48), "SELECT o.id, o.type, o.created_at_epoch - a.created_at_epoch AS offset_s FROM obs o, (SELECT created_at_epoch FROM obs WHERE id = 42) a WHERE abs(o.created_at_epoch - a.created_at_epoch) <= 172800")
on_obs("observations_by_file", lambda o: M.by_file(o, "en/src1.py"), "SELECT id, file_path, importance, created_at_epoch FROM obs WHERE file_path = 'en/src1.py' OR file_path LIKE '%/en/src1.py'")
on_obs("auto_links", M.symbol_links, "SELECT hub AS source_id, id AS target_id FROM (SELECT id, min(id) OVER (PARTITION BY project_root, symbol) AS hub FROM obs) WHERE id <> hub")
add("memory_health", lambda spark, d: M.health(observations(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))),
    "SELECT count(*) AS total, count(*) FILTER (length(trim(text)) < 40) AS incomplete, count(vec_id) AS indexed, round(100.0 * count(vec_id) / count(*), 4)::DOUBLE AS coverage_pct FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
on_obs("session_budget", lambda o: M.session_budget(o, 50_000), "SELECT *, CASE WHEN pct >= 75 THEN 'critical' WHEN pct >= 50 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT session_id, sum(length(content) // 4)::BIGINT AS tokens, round(100.0 * sum(length(content) // 4) / 50000, 4)::DOUBLE AS pct FROM obs GROUP BY 1)")
on_obs("corpus_build", lambda o: M.corpus(o, ["guardrail", "warning"], ["sym7"]), "SELECT id, type, symbol FROM obs WHERE type IN ('guardrail', 'warning') OR symbol = 'sym7'")
on_obs("latest_per_session", M.latest_per_session, "SELECT id, session_id, place FROM (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at_epoch DESC, id) AS place FROM obs) WHERE place <= 3")
on_obs("relative_age", lambda o: o.select("id", C.relative_age(F.col("created_at_epoch"), NOW).alias("age")), f"""SELECT id, CASE WHEN d < 3600 THEN greatest(1, d // 60) || 'm ago' WHEN d < 86400 THEN d // 3600 || 'h ago' WHEN d < 604800 THEN d // 86400 || 'd ago' WHEN d < 2592000 THEN d // 604800 || 'w ago' WHEN d < 31536000 THEN d // 2592000 || 'mo ago' ELSE d // 31536000 || 'y ago' END AS age FROM (SELECT id, {NOW} - created_at_epoch AS d FROM obs)""")
on_obs("private_strip", lambda o: o.select("id", C.strip_private(F.concat(F.lit("<private>"), "title", F.lit("</private> "), "symbol")).alias("text")), "SELECT id, trim(regexp_replace('<private>' || title || '</private> ' || symbol, '(?is)<private>.*?</private>', '[PRIVATE]', 'g')) AS text FROM obs")
on_obs("fts_query", lambda o: o.select("id", C.fts_query(F.col("title")).alias("query")), f"""SELECT id, array_to_string(list_transform(list_filter(regexp_extract_all(title, '[A-Za-zÀ-ÿ0-9_]{{3,}}'), lambda t: lower(t) NOT IN {rules.FTS_STOPWORDS!r})[1:12], lambda t: '"' || t || '"'), ' OR ') AS query FROM obs""")
