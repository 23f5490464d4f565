"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import park

ROUNDS = 50


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges (a, b): every other node and the smallest of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contract(edges: DataFrame, rows: int = 200_000) -> DataFrame:
    """edges (a, b: long) with those of each batch replaced by stars: the same components, fewer edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= rows:
                yield pa.record_batch(list(map(pa.array, forest(*map(np.concatenate, zip(*held))))), ["a", "b"])
                held, n = [], 0
        if n:
            yield pa.record_batch(list(map(pa.array, forest(*map(np.concatenate, zip(*held))))), ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long) that is not itself the smallest of its component.

    Each round attaches every node's larger neighbours to its smallest, then its smaller ones too; minima are
    pre-aggregated, and the join that follows may be split by AQE, so a node with very many edges is no single task.
    """
    now = park(contract(edges.where("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = park(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select("b", "low").where("b <> low").union(low.select("a", "low")).toDF("a", "b").distinct()
        after = park(small, "small")
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
    raise RuntimeError(f"no end after {ROUNDS} rounds")
