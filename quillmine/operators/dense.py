"""Exact passes over dense vectors (id: long, embedding: array) in blocks: each pair of blocks is one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

BLOCK = 1024


def pack(vectors: DataFrame, unit: bool) -> DataFrame:
    """(block, ids, data): blocks of vectors as bytes (long, double), scaled to length 1 if unit. Rows without a vector, or without a direction if unit, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                data = np.array(part.column("embedding").to_pylist(), np.float64)
                ids = part.column("id").to_numpy()
                if unit:
                    norm = np.sqrt((data * data).sum(1))
                    ids, data = ids[norm > 0], data[norm > 0] / norm[norm > 0, None]
                yield pa.record_batch([pa.array([ids.tobytes()]), pa.array([data.tobytes()])], ["ids", "data"])

    rows = vectors.where("id IS NOT NULL AND size(embedding) > 0").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cut(rows.mapInArrow(run, "ids binary, data binary").withColumn("block", F.monotonically_increasing_id()))


def _matrix(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(data, np.float64).reshape(len(own), -1) if len(own) else np.zeros((0, 1))


def _cells(left: DataFrame, right: DataFrame, half: bool) -> DataFrame:
    out = left.toDF("ia", "da", "ba").crossJoin(right.toDF("ib", "db", "bb"))
    return (out.where("ba <= bb") if half else out).select("ia", "da", "ib", "db", (F.col("ba") == F.col("bb")).alias("same"))


def near(vectors: DataFrame, least: float) -> DataFrame:
    """Edges (src, dst), src < dst, whose components are those of all pairs of cosine least or more."""
    packed = pack(vectors, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ia, da, ib, db, _ = (batch.column(c)[k].as_py() for c in range(5))
                (a, x), (b, y) = _matrix(ia, da), _matrix(ib, db)
                if not len(a) or not len(b):
                    continue
                i, j = np.nonzero(x @ y.T >= least - 1e-12)
                src, dst = _star(a[i], b[j])
                yield pa.record_batch([pa.array(src), pa.array(dst)], ["src", "dst"])

    return _cells(packed, packed, True).mapInArrow(run, "src long, dst long")


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node and every other node of each component of the edges (a, b)."""
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
    return nodes[root[other]], nodes[other]


def top(vectors: DataFrame, queries: DataFrame, k: int, unit: bool = False, itself: bool = True, least: float | None = None) -> DataFrame:
    """(query, id, score, place): for every row of queries (id, embedding) the k rows of vectors of largest dot product (cosine if unit), score to 6 digits, then id; without the row itself if not itself, and only from least on."""
    cells = _cells(pack(queries, unit), pack(vectors, unit), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(batch.num_rows):
                ia, da, ib, db, _ = (batch.column(f)[c].as_py() for f in range(5))
                (a, x), (b, y) = _matrix(ia, da), _matrix(ib, db)
                if not len(a) or not len(b):
                    continue
                order = np.argsort(b, kind="stable")
                b, score = b[order], np.round(x @ y[order].T, 6)
                if not itself:
                    score[a[:, None] == b[None, :]] = -np.inf
                floor = np.partition(score, max(0, len(b) - k), axis=1)[:, max(0, len(b) - k)]
                i, j = np.nonzero((score >= floor[:, None]) & (score >= (-np.finfo(float).max if least is None else least)))
                # the k best of each query: of ties at the floor those of smallest id
                order = np.lexsort((j, -score[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[keep], j[keep]
                yield pa.record_batch([pa.array(a[i]), pa.array(b[j]), pa.array(score[i, j])], ["query", "id", "score"])

    found = cells.mapInArrow(run, "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
