"""Queries of the kept vector index over whole embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector_index as V
from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Neighbours, and lists that a query probes, of V.LISTS.
K, PROBES = 10, 40


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def asked(s, d):
    """Every vector whose number 50 divides."""
    return vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("query"), "embedding")


def indexed(s, d) -> V.VectorIndex:
    index = V.VectorIndex(s, V.new_path(s))
    index.sync(vectors(s, d))
    return index


def semantic_search(s, d):
    return indexed(s, d).search(asked(s, d), K, PROBES)


def semantic_search_probing(s, d):
    return indexed(s, d).search(asked(s, d), K, PROBES, exact=False)


def vector_reindex(s, d):
    """What three looks at the table change: all of it new; every third vector turned round and every seventh gone; and back."""
    index, rows = V.VectorIndex(s, V.new_path(s)), vectors(s, d)
    turned = F.when(F.col("id") % 3 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    looks = [rows, rows.where("id % 7 <> 0").select("id", turned.alias("embedding")), rows, rows]
    counts = [(n, *index.sync(x).values()) for n, x in enumerate(looks, 1)]
    return s.createDataFrame(counts, "look int, unchanged long, indexed long, pruned long")


QUERIES |= {"semantic_search": semantic_search, "semantic_search_probing": semantic_search_probing, "vector_reindex": vector_reindex}
ORACLES["semantic_search"] = """WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT q.id AS query, e.id, round(greatest(0, list_sum(list_transform(range(1, len(e.v) + 1), lambda i: e.v[i] * q.v[i]))), 6) AS score FROM u e, u q WHERE q.id % 50 = 0)
SELECT query, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10"""
ORACLES["vector_reindex"] = """WITH n AS (SELECT count(*) AS a, count(*) FILTER (vec_id % 7 = 0) AS gone, count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 3 = 0) AS turned FROM embeddings)
SELECT 1 AS look, 0 AS unchanged, a AS indexed, 0 AS pruned FROM n UNION ALL SELECT 2, a - gone - turned, turned, gone FROM n UNION ALL SELECT 3, a - gone - turned, turned + gone, 0 FROM n UNION ALL SELECT 4, a, 0, 0 FROM n"""
