"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import asof_queries, code_queries, fulltext_queries, fuzzy_queries, graph_queries, memory_queries, project_queries, relational_queries, search_queries, state_queries, store_queries, stream_queries, vector_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (asof_queries, memory_queries, search_queries, fulltext_queries, fuzzy_queries, graph_queries, code_queries, project_queries, relational_queries, state_queries, store_queries, stream_queries, vector_queries)
QUERIES: dict[str, Query] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
