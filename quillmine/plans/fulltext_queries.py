"""Queries of the kept full-text index over whole documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext as X
from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def maintained(s, d) -> X.FullText:
    """An index that whole documents reach in three batches: beginnings, then updates and deletions, then the rest. It ends as one built from documents at once."""
    index, rows = X.FullText(s, X.new_path(s)), docs(s, d)
    index.apply(rows.withColumn("text", F.substring("text", 1, 200)))
    index.apply(rows.where("id % 2 = 0"), rows.where("id % 3 = 0").select("id"))
    index.apply(rows.where("id % 2 = 1 OR id % 3 = 0"))
    return index


def items(s, d):
    """Every benchmark item whose number 50 divides."""
    return table(s, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text")


def beginnings(s, d):
    """The first three words of every document whose number 50 divides, as a phrase."""
    return docs(s, d).where("id % 50 = 0").select(F.col("id").alias("query"), F.array_join(F.slice(X.words(F.col("text")), 1, 3), " ").alias("text"))


def fulltext_search(s, d):
    index, queries = maintained(s, d), items(s, d)
    return X.with_excerpts(index.search(queries, 40), docs(s, d), queries).drop("place")


def fulltext_phrase(s, d):
    index = maintained(s, d)
    index.merge()
    return index.phrase(beginnings(s, d))


def fulltext_terms(s, d):
    """Every term of the index: in how many documents, how often, and where first in its first document."""
    rows = maintained(s, d).postings()
    n = F.size("positions")
    return rows.groupBy("term").agg(F.count("*").alias("documents"), F.sum(n).alias("places"), F.min(F.struct("id", F.col("positions")[0].alias("at")))["at"].alias("first_at"))


_W = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z0-9_]{{3,}}')"
_D = f"dt AS MATERIALIZED (SELECT doc_id AS id, text, {_W.format('text')} AS t FROM documents), q AS (SELECT item_id AS query, {_W.format('text')} AS w FROM benchmark WHERE item_id % 50 = 0)"
add("fulltext_search", fulltext_search, rf"""WITH {_D}, qt AS (SELECT query, unnest(list_distinct(w)) AS term FROM q), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM dt),
p AS (SELECT id, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS spot FROM dt),
tf AS (SELECT id, dl, term, count(*) AS tf, min(spot) AS spot FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT query, id, min(spot) AS first, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6)::DOUBLE AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY query, id),
h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 40),
x AS (SELECT h.*, q.w AS terms, regexp_extract_all(text, '[A-Za-z0-9_]{{3,}}') AS found, string_split_regex(text, '[A-Za-z0-9_]{{3,}}') AS gaps, len(t) AS n, greatest(0, least(first - 10, len(t) - 40)) AS s FROM h JOIN dt USING (id) JOIN q USING (query)),
y AS (SELECT *, least(n, s + 40) AS e FROM x)
SELECT query, id, score, first, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(range(s, e), lambda i: CASE WHEN list_contains(terms, translate(found[i + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) THEN '»' || found[i + 1] || '«' ELSE found[i + 1] END
  || CASE WHEN i < e - 1 THEN gaps[i + 2] ELSE '' END), '') || CASE WHEN e < n THEN '...' ELSE '' END AS excerpt FROM y""")
add("fulltext_phrase", fulltext_phrase, f"""WITH {_D}, f AS (SELECT id AS query, t[1:3] AS w FROM dt WHERE id % 50 = 0 AND len(t) > 0),
p AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS spot FROM dt),
m AS (SELECT query, id, spot FROM f JOIN p ON term = w[1] JOIN dt USING (id) WHERE t[spot + 1 : spot + len(w)] = w)
SELECT query, id, min(spot) AS first, count(*) AS hits FROM m GROUP BY query, id""")
add("fulltext_terms", fulltext_terms, f"""WITH {_D}, p AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS spot FROM dt), g AS (SELECT id, term, count(*) AS k, min(spot) AS spot FROM p GROUP BY ALL)
SELECT term, count(*) AS documents, sum(k)::BIGINT AS places, arg_min(spot, id) AS first_at FROM g GROUP BY term""")
