"""Queries of the training-data operators, with their result contracts and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, media, mixing, periods, phrases, quality, secrets, simhash, suffixes, token_scan, toxicity, turns, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS t FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM r WHERE n > 1),
l AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: From the definition: words that agree on a diagonal, and the best stretch there; no seeds.
OP4_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
bp AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM b WHERE len(w) >= 5),
dp AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
laid AS (SELECT doc_id, item_id, n, dp.p - bp.p AS shift, list(bp.p) AS hit FROM dp JOIN bp USING (word)
         GROUP BY doc_id, item_id, n, shift HAVING count(*) >= ceil(least(n, 13) * 0.8)),
best AS (SELECT doc_id, item_id, n, len(hit) AS matched,
         list_max(list_transform(range(1, n - least(n, 13) + 2), lambda k: len(list_filter(hit, lambda x: x >= k AND x < k + least(n, 13))))) AS agreeing FROM laid)
SELECT doc_id, item_id, CAST(max(agreeing) AS INTEGER) AS agreeing, CAST(max(matched) AS INTEGER) AS matched, CAST(any_value(n) AS INTEGER) AS item_words
FROM best WHERE agreeing >= ceil(least(n, 13) * 0.8) GROUP BY doc_id, item_id
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_texts(table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    line = secrets.joined_spans(F.col("spans"))
    return found.select(
        F.col("path").alias("doc_id"),
        *[secrets.count_of(F.col("spans"), i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.RULES)],
        F.sha2(line, 256).alias("base_sha256"),
        line.alias("spans"),
    )


def _duck_spans(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, g AS start, g + length(m) AS stop FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))) AS g,
        unnest(m) AS m, unnest(v) AS v FROM (
        SELECT doc_id, regexp_extract_all(text, $re${pattern}$re$) AS m, regexp_extract_all(text, $re${pattern}$re$, {group}) AS v, string_split_regex(text, $re${pattern}$re$) AS gap
        FROM documents WHERE text IS NOT NULL)) WHERE length(v) >= {least}"""


OP8_SQL = (
    "WITH s AS ("
    + " UNION ALL ".join(_duck_spans(i, r.kind, {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(r.kind, r.pattern), r.group, r.least) for i, r in enumerate(secrets.RULES))
    + """), a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN a USING (doc_id)"""
)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_tokens(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM z GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST(number % 3 + 1 AS BIGINT)] AS weight, source_size * 3 AS lim FROM p),
o AS (SELECT *, row_number() OVER t AS place, coalesce(sum(lim) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(weight) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining, sum(source_size) OVER () AS total
      FROM w WINDOW t AS (ORDER BY source_size / weight, number)),
f AS (SELECT *, CAST(total - before AS DOUBLE) / remaining AS share FROM o),
c AS (SELECT min_by(share, place) AS share, min(place) AS place FROM f WHERE lim > share * weight),
t AS (SELECT f.source, source_size, CASE WHEN c.place IS NULL OR f.place < c.place THEN CAST(lim AS DOUBLE) ELSE c.share * weight END AS target FROM f LEFT JOIN c ON true),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

def op11_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periods.repeats(table(spark, sf_dir, "documents"), periods.damage)
    return runs.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


#: CRC-32 of a short text of ASCII characters, for a table tab of its 256 steps; tab comes from the polynomial.
_CRC_TABLE = """tab AS MATERIALIZED (SELECT list(v ORDER BY n) AS steps FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n)))"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


#: Equal words are paired, islands of consecutive pairs at one distance are the stretches.
OP12_SQL = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, tab),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM e),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM f),
q AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 3 <= a.n),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM q) GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, arg_min([start, length, period], (-(length / period), start, period)) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period, 1000 * top[2] // top[3] AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turns.repair(turns.damage(rows), rows)


def _duck_edit(cell: str, cost: str, letter: str) -> str:
    """A cell is its cost in nine digits and its audit, so the least of them as text is the cheapest."""
    return f"lpad(CAST(CAST({cell}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {cell}[10:] || '{letter}'"


def _duck_step(own: str, before: str, initial: str) -> str:
    edits = ", ".join(f"CASE WHEN free THEN CASE WHEN ini = '{initial}' THEN {_duck_edit(b, 'more', 'K')} ELSE {_duck_edit(b, '(more + 3)', 'R')} END END" for b in before.split())
    return f"least({_duck_edit(own, '4', 'D')}, {edits})"


#: Turn by turn, with the four states as columns.
OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), '~') AS c,
      {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, tab),
d AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS r FROM d),
f AS (SELECT *, regexp_replace(text, '[ 	-]', '', 'g') AS seen, row_number() OVER (PARTITION BY c, role, text ORDER BY r) AS nth, lag(role) OVER (PARTITION BY c ORDER BY r) AS prior FROM r),
e AS MATERIALIZED (SELECT c, r, turn, role, text, prior, role[1] AS ini, CASE WHEN seen = '' THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(seen, '[.!?]$') THEN 3 ELSE 0 END AS fault FROM f),
g AS (SELECT *, fault NOT IN (1, 2) AS free, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM e),
z(c, r, v0, v1, v2, v3) AS (
  SELECT DISTINCT c, 0::BIGINT, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM e
  UNION ALL SELECT c, r, n0, n1, w2, least(n3, {_duck_edit("w2", "3", "I")}) FROM (
    SELECT *, least(n2, {_duck_edit("n0", "3", "I")}, {_duck_edit("n1", "3", "I")}, {_duck_edit("n3", "3", "I")}) AS w2 FROM (
      SELECT c, g.r, {_duck_edit("v0", "4", "D")} AS n0, least({_duck_edit("v1", "4", "D")}, CASE WHEN free AND ini = 's' THEN {_duck_edit("v0", "more", "K")} END) AS n1,
        {_duck_step("v2", "v0 v1 v3", "u")} AS n2, {_duck_step("v3", "v2", "a")} AS n3 FROM z JOIN g USING (c) WHERE g.r = z.r + 1))),
b AS (SELECT c, least(v0, v3) AS cell FROM z QUALIFY r = max(r) OVER (PARTITION BY c)),
a AS (SELECT c, CAST(cell[1:9] AS BIGINT) AS cost, cell[10:] AS audit FROM b),
l AS (SELECT c, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS p FROM a WHERE audit <> ''),
t AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY c ORDER BY p) AS r FROM l),
k AS (SELECT t.c, p, letter, e.role, e.text, row_number() OVER (PARTITION BY t.c ORDER BY p) AS place FROM t LEFT JOIN e ON t.c = e.c AND t.r = e.r WHERE letter <> 'D'),
s AS (SELECT *, max(CASE WHEN place = 1 AND letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS lead FROM k),
h AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS kept FROM s GROUP BY c),
n AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (prior IS NOT NULL AND prior[1] || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(kept, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, c FROM o) LEFT JOIN n USING (c) LEFT JOIN a USING (c) LEFT JOIN h USING (c)
"""


QUERIES: dict[str, Query] = {
    "op1_phrase_dedup": op1_phrase_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_avi_mjpeg": op6_avi_mjpeg,
    "op7_simhash": op7_simhash,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_source_mix": op10_source_mix,
    "op11_quality_fm": op11_quality_fm,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES: dict[str, str] = {
    "op1_phrase_dedup": OP1_SQL,
    "op4_decontamination": OP4_SQL,
    "op8_secret_scan": OP8_SQL,
    "op10_source_mix": OP10_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_turn_repair": OP13_SQL,
}
