"""Queries of retrieval, sequences, captures and text, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import dense
from ..operators import search as S
from ..operators import sequence as Q
from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def bm25_each(s, d, limit=40):
    return S.bm25_each(docs(s, d), table(s, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text"), limit)


def knn_each(s, d, k=40):
    return dense.top(vectors(s, d), vectors(s, d).where("id % 50 = 0"), k)


# Queries of the searches: every row whose id 50 divides, against all rows.
_T = "regexp_extract_all(lower(text), '[a-z0-9_]{3,}')"
_BM = f"""q AS (SELECT item_id AS query, unnest(list_distinct({_T})) AS term FROM benchmark WHERE item_id % 50 = 0), dt AS (SELECT doc_id AS id, {_T} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM dt),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bs AS (SELECT query, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6)::DOUBLE AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY query, id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS p FROM bs QUALIFY p <= 40)"""
_KN = """ks AS (SELECT z.vec_id AS query, e.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * z.embedding[i]::DOUBLE)), 6) AS score FROM embeddings e, embeddings z WHERE z.vec_id % 50 = 0),
kn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS p FROM ks QUALIFY p <= 40)"""
add("bm25_search", lambda s, d: bm25_each(s, d).drop("place"), f"WITH {_BM} SELECT query, id, score FROM bm")
add("knn_search", lambda s, d: knn_each(s, d).drop("place"), f"WITH {_KN} SELECT query, id, score FROM kn")
add("hybrid_search", lambda s, d: S.rrf_each([bm25_each(s, d), knn_each(s, d)], 20),
    f"""WITH {_BM}, {_KN}, f AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + p)), 6) AS score FROM (SELECT query, id, p FROM bm UNION ALL SELECT query, id, p FROM kn) GROUP BY query, id)
    SELECT query, id, score FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 20""")


def files(spark, d):
    return table(spark, d, "documents").select(F.format_string("doc/%06d", "doc_id").alias("path"), "text")


_L = "ln AS (SELECT format('doc/{:06d}', doc_id) AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
add("regex_search", lambda s, d: S.regex_search(files(s, d), "(license|Lizenz|password)"),
    f"WITH {_L} SELECT path, line_no::INTEGER AS line_no, CASE WHEN length(line) > 160 THEN substr(line, 1, 160) || '…' ELSE line END AS line FROM ln WHERE regexp_matches(line, '(license|Lizenz|password)') ORDER BY path, line_no LIMIT 100")
add("search_in_symbols", lambda s, d: S.enclosing(S.lines(files(s, d)).where(F.col("line").rlike("thtion")).select("path", "line_no"), S.paragraphs(files(s, d))),
    f"""WITH {_L}, w AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS part FROM ln),
    sy AS (SELECT path, 'part' || part AS name, min(line_no) AS s, max(line_no) AS e FROM w WHERE trim(line) <> '' GROUP BY path, part)
    SELECT h.path, h.line_no::INTEGER AS line_no, min_by(name, (e - s) * 100000 + s) AS symbol FROM ln h LEFT JOIN sy ON h.path = sy.path AND h.line_no BETWEEN s AND e WHERE regexp_matches(line, 'thtion') GROUP BY 1, 2""")
add("line_offsets", lambda s, d: S.lines(files(s, d)).groupBy("path").agg(F.count("*").alias("total_lines"), F.sum(F.length("line") + 1).alias("total_chars")),
    f"WITH {_L} SELECT path, count(*) AS total_lines, sum(length(line) + 1)::BIGINT AS total_chars FROM ln GROUP BY 1")
add("prompt_patterns", lambda s, d: S.prompt_patterns(table(s, d, "conversations").where("role = 'user'")),
    "SELECT token, count(*) AS prompts FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS token FROM conversations WHERE role = 'user') GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 30")


def calls(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("state"), F.get_json_object("props", "$.k").alias("symbol"), "value")


_P = "pr AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), tr AS (SELECT state, next, count(*) AS n FROM pr WHERE next IS NOT NULL GROUP BY ALL), tp AS (SELECT *, round(n / sum(n) OVER (PARTITION BY state), 6)::DOUBLE AS p FROM tr)"
add("markov_transitions", lambda s, d: Q.transitions(calls(s, d)), f"WITH {_P} SELECT * FROM tp")
add("markov_predict", lambda s, d: Q.predict(calls(s, d)), f"WITH {_P} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, next)::INTEGER AS place FROM tp) WHERE place <= 3")
_BEAM = f"""WITH {_P}, st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, next) AS k FROM tp) WHERE k <= 3 AND p >= 0.15),
b1 AS (SELECT [next] AS path, p FROM st WHERE state = 'view' ORDER BY p DESC, array_to_string([next], '>') LIMIT 3),
b2 AS (SELECT CASE WHEN next IS NULL THEN path ELSE list_append(path, next) END AS path, b1.p * coalesce(st.p, 1) AS p FROM b1 LEFT JOIN st ON state = path[-1] ORDER BY 2 DESC, array_to_string(CASE WHEN next IS NULL THEN path ELSE list_append(path, next) END, '>') LIMIT 3),
b3 AS (SELECT CASE WHEN next IS NULL THEN path ELSE list_append(path, next) END AS path, b2.p * coalesce(st.p, 1) AS p FROM b2 LEFT JOIN st ON state = path[-1] ORDER BY 2 DESC, array_to_string(CASE WHEN next IS NULL THEN path ELSE list_append(path, next) END, '>') LIMIT 3)
SELECT array_to_string(path, '>') AS path, round(p, 6) AS p FROM b3"""
add("markov_beam", lambda s, d: Q.beam(calls(s, d), "view"), _BEAM)
_C2 = "cx AS (SELECT lag(event_type, 2) OVER w AS a, lag(event_type) OVER w AS last, event_type AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), pp AS (SELECT a || '>' || last AS context, last, next, count(*) AS n FROM cx WHERE a IS NOT NULL AND last IS NOT NULL GROUP BY ALL)"
add("ppm_contexts", lambda s, d: Q.ppm_contexts(calls(s, d)), f"WITH {_C2} SELECT context, next, n FROM pp")
add("ppm_predict", lambda s, d: Q.ppm_predict(calls(s, d)), f"WITH {_P}, {_C2}, t AS (SELECT *, sum(n) OVER (PARTITION BY context) AS total FROM pp) SELECT * FROM (SELECT context, t.next, round(0.9 * t.n / total + 0.1 * coalesce(p, 0), 6)::DOUBLE AS p FROM t LEFT JOIN tp ON tp.state = last AND tp.next = t.next WHERE total >= 3) WHERE p > 0.05")
_A = "ac AS (SELECT DISTINCT user_id AS session, event_type AS symbol FROM events WHERE value > 100), co AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n FROM ac x JOIN ac y ON x.session = y.session AND x.symbol < y.symbol GROUP BY ALL)"
act = lambda s, d: calls(s, d).where("value > 100").select("session", F.col("state").alias("symbol"))
add("coactivation", lambda s, d: Q.coactivation(act(s, d)), f"WITH {_A} SELECT * FROM co")
add("npmi", lambda s, d: Q.npmi(act(s, d)), f"WITH {_A}, e AS (SELECT symbol, count(*)::DOUBLE AS n FROM ac GROUP BY 1), t AS (SELECT sum(n) AS t FROM e) SELECT a, b, round(ln(co.n / t * t * t / (x.n * y.n)) / -ln(co.n / t), 6) AS npmi FROM co JOIN e x ON x.symbol = a JOIN e y ON y.symbol = b, t WHERE co.n >= 2")
add("context_type", lambda s, d: Q.context_type(calls(s, d)), """WITH r AS (SELECT user_id AS session, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT session, CASE WHEN bool_or(s = 'purchase') THEN 'edit' WHEN bool_or(s = 'search') THEN 'review' WHEN bool_or(s IN ('view', 'click')) THEN 'navigation' ELSE 'unknown' END AS context_type FROM r WHERE k <= 5 GROUP BY 1""")
_SG = """sg AS (SELECT user_id AS session, 'tool:' || event_type AS dim, round(count(*) / any_value(t), 6)::DOUBLE AS value FROM events JOIN (SELECT user_id, count(*) AS t FROM events GROUP BY 1) USING (user_id) WHERE event_type IN ('view', 'click') GROUP BY user_id, event_type
UNION ALL SELECT session, 'bucket:' || bucket, round(n / max(n) OVER (PARTITION BY session), 6)::DOUBLE FROM (SELECT session, CAST('0x' || substr(md5(symbol), 1, 8) AS BIGINT) % 13 AS bucket, count(*) AS n FROM (SELECT DISTINCT user_id AS session, json_extract_string(props, '$.k') AS symbol FROM events) WHERE symbol IS NOT NULL GROUP BY ALL))"""
sig = lambda s, d: Q.session_signature(calls(s, d), ["view", "click"])
add("session_signature", sig, f"WITH {_SG} SELECT * FROM sg")
add("similar_sessions", lambda s, d: Q.similar_each(sig(s, d), F.col("id") % 50 == 0),
    f"""WITH {_SG}, n AS (SELECT session, sqrt(sum(value * value)) AS n FROM sg GROUP BY 1),
    p AS (SELECT x.session AS query, y.session AS session, sum(x.value * y.value) AS dot FROM sg x JOIN sg y USING (dim) WHERE x.session % 50 = 0 AND x.session <> y.session GROUP BY ALL),
    c AS (SELECT query, p.session, round(dot / (a.n * b.n), 6) AS similarity FROM p JOIN n a ON a.session = query JOIN n b ON b.session = p.session)
    SELECT query, session, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, session) AS k FROM c WHERE similarity >= 0.5) WHERE k <= 3""")
add("lattice_stats", lambda s, d: Q.lattice(calls(s, d), F.col("value") > 100), "SELECT event_type AS state, round((1 + count(*) FILTER (value > 100)) / (2 + count(*)), 6)::DOUBLE AS mean, count(*) AS trials FROM events GROUP BY 1")


def bandit(spark, d):
    e = table(spark, d, "events")
    f = F.array(F.lit(1.0), F.round(F.col("value") / 1000, 3), (F.col("event_id") % 7 / 7.0))
    return e.select(F.col("event_id").alias("id"), f.alias("f"), (F.col("event_type") == "purchase").cast("double").alias("r"))


add("linucb_design", lambda s, d: Q.linucb_design(bandit(s, d), "f", "r").withColumn("a", F.round("a", 3)),
    "WITH f AS (SELECT [1.0::DOUBLE, round(value / 1000, 3), event_id % 7 / 7.0::DOUBLE] AS f, (event_type = 'purchase')::INT::DOUBLE AS r FROM events), k AS (SELECT unnest([0, 1, 2])::INTEGER AS ki), l AS (SELECT unnest([0, 1, 2, -1])::INTEGER AS kj), g AS (SELECT ki, kj, sum(f[ki + 1] * CASE WHEN kj < 0 THEN r ELSE f[kj + 1] END) AS t FROM f, k, l GROUP BY ki, kj) SELECT ki AS i, kj AS j, round(round(t + CASE WHEN ki = kj THEN 1 ELSE 0 END, 6), 3)::DOUBLE AS a FROM g")
# the inverse of the symmetric 3x3 matrix by its cofactors
add("linucb_rank", lambda s, d: Q.linucb_rank(bandit(s, d), Q.linucb_design(bandit(s, d), "f", "r"), "f"),
    """WITH f AS (SELECT event_id AS id, 1.0::DOUBLE AS x, round(value / 1000, 3) AS y, event_id % 7 / 7.0::DOUBLE AS z, (event_type = 'purchase')::INT::DOUBLE AS r FROM events),
    g AS (SELECT round(sum(x * x) + 1, 6) AS a, round(sum(x * y), 6) AS b, round(sum(x * z), 6) AS c, round(sum(y * y) + 1, 6) AS d, round(sum(y * z), 6) AS e, round(sum(z * z) + 1, 6) AS f, round(sum(x * r), 6) AS u, round(sum(y * r), 6) AS v, round(sum(z * r), 6) AS w FROM f),
    h AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g),
    i AS (SELECT (d * f - e * e) / det AS p, (c * e - b * f) / det AS q, (b * e - c * d) / det AS s, (a * f - c * c) / det AS t, (b * c - a * e) / det AS k, (a * d - b * b) / det AS l, u, v, w FROM h)
    SELECT id, round(x * (p * u + q * v + s * w) + y * (q * u + t * v + k * w) + z * (s * u + k * v + l * w)
    + sqrt(greatest(p * x * x + t * y * y + l * z * z + 2 * (q * x * y + s * x * z + k * y * z), 0)), 4)::DOUBLE AS score FROM f, i""")
add("capture_preview", lambda s, d: docs(s, d).select("id", C.preview(F.col("text")).alias("preview")),
    """WITH l AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS l FROM documents), t AS (SELECT id, text, array_to_string(list_concat(l[1:8], ['... [' || (len(l) - 16) || ' lines omitted] ...'], l[greatest(1, len(l) - 7):len(l)]), chr(10)) AS p FROM l)
    SELECT id, CASE WHEN length(text) <= 800 THEN text WHEN length(p) > 800 THEN substr(p, 1, 800) || '…' ELSE p END AS preview FROM t""")
add("capture_aggregate", lambda s, d: docs(s, d).select("id", F.length("text").alias("chars"), F.size(F.split("text", "\n", -1)).alias("lines"), F.size(F.array_distinct(F.split("text", "\n", -1))).alias("unique_lines"), F.regexp_count("text", F.lit("the")).alias("hits")),
    "SELECT doc_id AS id, length(text)::INTEGER AS chars, len(string_split(text, chr(10)))::INTEGER AS lines, len(list_distinct(string_split(text, chr(10))))::INTEGER AS unique_lines, len(regexp_extract_all(text, 'the'))::INTEGER AS hits FROM documents")
add("entropy", lambda s, d: table(s, d, "nation").select("n_name", F.round(C.entropy(F.col("n_name")), 6).alias("entropy")),
    "SELECT n_name, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (SELECT n_name, ch, count(*)::DOUBLE AS c, any_value(length(n_name))::DOUBLE AS n FROM (SELECT n_name, unnest(string_split(n_name, '')) AS ch FROM nation) WHERE ch <> '' GROUP BY 1, 2) GROUP BY 1")
add("levenshtein", lambda s, d: table(s, d, "nation").alias("a").join(table(s, d, "nation").alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").alias("distance")).where("distance <= 4"),
    "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name WHERE levenshtein(a.n_name, b.n_name) <= 4")
add("truncate_output", lambda s, d: docs(s, d).select("id", F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("... [truncated "), (F.length("text") - 500).cast("string"), F.lit(" chars]"))).otherwise(F.col("text")).alias("out")),
    "SELECT doc_id AS id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '... [truncated ' || (length(text) - 500) || ' chars]' ELSE text END AS out FROM documents")
add("telemetry_counts", lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("client"), F.col("event_type").alias("tool")).agg(F.count("*").alias("calls")), "SELECT user_id AS client, event_type AS tool, count(*) AS calls FROM events GROUP BY ALL")
