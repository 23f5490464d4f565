"""A kept inverted-file index of vectors: lists around centroids, kept up by content hash, probed or searched exactly.

Layout below one folder: rows/seg=<n>/list=<l> holds (id, hash, vec, dist), vec being the unit vector and dist its
distance to the centroid of list l; gone/seg=<n> holds ids whose rows in segments before n are dead. Centroids are fitted
once, on the driver, by Lloyd's steps on at most SAMPLE vectors picked by hash; every row is assigned. sync() takes the
whole table as it is now: rows whose content hash the index has are not assigned again, changed and new ones are appended
as a segment, vanished ones go.

A search gives every query to the lists of its nearest centroids. The exact way then takes the k-th distance found, d: a
list of radius r around c can hold something nearer only if |q - c| - r <= d (triangle inequality), and those lists are
read too; nothing outside them can be nearer, so the result is that of comparing all. Rows and queries meet by list, in
blocks of at most PACK, and each pair of blocks is one matrix product.

Scores are max(0, 1 - |q - v|**2 / 2) of unit vectors, which is their cosine where that is positive. Cases: null vectors,
null ids and vectors of another width are not indexed; a vector of zeros stays zeros, at score 0.5 to all; of rows that
share an id one (the greatest hash) stays; a search of an empty index gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import _folder, cut

#: Vectors that the centroids are fitted on at most, lists, and steps of the fit.
SAMPLE, LISTS, STEPS = 20_000, 64, 12
#: Rows of one block.
PACK = 2048
SPREAD = 4
#: Distances that a task holds at once, about.
AT_ONCE = 1 << 18


def new_path(spark: SparkSession) -> str:
    return f"{_folder(spark)}/quillmine/vectors-{uuid.uuid4().hex}"


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.float64()))


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * rows @ centres.T
    return np.sqrt(np.maximum(square, 0))


def nearest(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, d) of the k rows v that are nearest to each of q, of equals (in nine decimals) the smaller id, for some of q at a time."""
    step = max(AT_ONCE // max(len(v), 1), 1)
    for a in range(0, len(q) if len(v) else 0, step):
        far = distances(q[a : a + step], v)
        short = np.round(far, 9)
        last = np.partition(short, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
        at, row = np.nonzero(short <= last[:, None])
        order = np.lexsort((ids[row], short[at, row], at))
        at, row = at[order], row[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, row = at[place < k], row[place < k]
        yield queries[a + at], ids[row], far[at, row]


def fit_centres(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))]
    for _ in range(STEPS):
        own = distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, lists: int = LISTS):
        self.spark, self.path, self.lists = spark, path.rstrip("/"), lists
        self.centres: np.ndarray | None = None
        self.segments: list[int] = []

    # -- keeping

    def _prepared(self, vectors: DataFrame) -> DataFrame:
        """(id, hash, embedding) of what can be indexed."""
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        rows = rows.where("id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
        rows = rows.withColumn("hash", F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")))
        return rows.groupBy("id").agg(F.max(F.struct("hash", "embedding")).alias("one")).select("id", "one.*")

    def _sample(self, rows: DataFrame) -> DataFrame:
        """The SAMPLE rows (embedding) of least hash. A bound on the hash leaves little more than those before they are ordered, so partitions do not send SAMPLE rows each."""
        rows = rows.where(F.size("embedding") > 0).select("id", F.md5(F.col("id").cast("string")).alias("key"), "embedding")
        n, share = rows.count(), 1.1
        while SAMPLE * share < n:
            some = rows.where(F.col("key") < f"{int((1 << 32) * SAMPLE * share / n):08x}")
            if some.count() >= SAMPLE:
                rows = some
                break
            share *= 2
        return rows.orderBy("key", "id").limit(SAMPLE).select("embedding")

    def _fit(self, rows: DataFrame) -> None:
        some = self._sample(rows).toArrow()["embedding"].combine_chunks()
        if len(some):
            long = some.value_lengths().to_numpy()
            width = max(zip(*reversed(np.unique(long, return_counts=True))))[1]  # of equally frequent ones the largest
            self.centres = fit_centres(unit(_matrix(some.filter(pa.array(long == width)), int(width))), self.lists)

    def _assigned(self, rows: DataFrame) -> DataFrame:
        centres = self.centres

        def run(batches):
            for batch in batches:
                vec = unit(_matrix(batch.column("embedding"), centres.shape[1]))
                far = distances(vec, centres)
                own = far.argmin(1)
                yield pa.record_batch([batch.column("id"), batch.column("hash"), _lists(vec), pa.array(far[np.arange(len(vec)), own]), pa.array(own.astype(np.int32))], ["id", "hash", "vec", "dist", "list"])

        return rows.where(F.size("embedding") == centres.shape[1]).mapInArrow(run, "id long, hash string, vec array<double>, dist double, list int")

    def sync(self, vectors: DataFrame) -> dict[str, int]:
        """Bring the index to vectors (id, embedding). How many rows were unchanged, indexed (new or changed) and pruned."""
        rows = cut(self._prepared(vectors))
        if self.centres is None:
            self._fit(rows)
        if self.centres is None:
            return {"unchanged": 0, "indexed": 0, "pruned": 0}
        rows = rows.where(F.size("embedding") == self.centres.shape[1])
        both = rows.select("id", "hash").join(self.rows().select("id", F.col("hash").alias("had")), "id", "full")
        state = F.when(F.col("hash").isNull(), "pruned").when(F.col("had").eqNullSafe(F.col("hash")), "unchanged").otherwise("indexed")
        states = cut(both.select("id", state.alias("state"), F.col("had").isNotNull().alias("old")))
        counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        # not broadcast, as the ids are as many as the rows
        fresh = rows.join(states.where("state = 'indexed'").select("id").hint("merge"), "id", "left_semi") if self.segments else rows
        if counts.get("indexed") or counts.get("pruned"):
            n = max(self.segments, default=0) + 1
            self._assigned(fresh).write.partitionBy("list").parquet(f"{self.path}/rows/seg={n}")
            states.where("state <> 'unchanged' AND old").select("id").write.parquet(f"{self.path}/gone/seg={n}")
            self.segments = [*self.segments, n]
        return {k: counts.get(k, 0) for k in ("unchanged", "indexed", "pruned")}

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(id, hash, vec, dist, list) of the index; of the given lists alone, if any."""
        schema = "id long, hash string, vec array<double>, dist double, list int, seg int"
        if not self.segments:
            return self.spark.createDataFrame([], schema).drop("seg")
        read = lambda name, s: self.spark.read.schema(s).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/seg={n}" for n in self.segments])
        rows = read("rows", schema)
        rows = rows.where(F.col("list").isin(lists)) if lists is not None else rows
        last = read("gone", "id long, seg int").groupBy("id").agg(F.max("seg").alias("last"))
        return rows.join(last, "id", "left").where("last IS NULL OR seg >= last").drop("last", "seg")

    # -- searching

    def _near(self, queries: DataFrame, radius: np.ndarray, probes: int, after: bool) -> DataFrame:
        """(query, vec, list): the probes nearest lists of each query; or, after those, all that the bound (column d) leaves."""
        centres = self.centres

        def run(batches):
            for batch in batches:
                vec = unit(_matrix(batch.column("embedding"), centres.shape[1]))
                far = distances(vec, centres)
                order = np.argsort(far, axis=1, kind="stable")
                chosen = np.zeros(far.shape, bool)
                np.put_along_axis(chosen, order[:, :probes], True, 1)
                if after:
                    d = batch.column("d").to_numpy(zero_copy_only=False)
                    chosen = ~chosen & (far - radius[None, :] <= d[:, None] + 1e-9)
                at, own = np.nonzero(chosen)
                for k in range(0, len(at), 4096):
                    part = at[k : k + 4096]
                    yield pa.record_batch([batch.column("query").take(pa.array(part)), _lists(vec[part]), pa.array(own[k : k + 4096].astype(np.int32))], ["query", "vec", "list"])

        return queries.mapInArrow(run, "query long, vec array<double>, list int")

    def _packed(self, rows: DataFrame, name: str) -> DataFrame:
        """(list, <name>s, <name>_vecs): blocks of at most PACK rows of one list."""
        width = self.centres.shape[1]

        def run(batches):
            for batch in batches:
                own = batch.column("list").to_numpy()
                for a in np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else ():
                    b = int(a + np.argmax(np.append(own[a:] != own[a], True)))
                    for k in range(int(a), b, PACK):
                        part = batch.slice(k, min(PACK, b - k))
                        flat = pa.array([_matrix(part.column("vec"), width).ravel()], pa.list_(pa.float64()))
                        yield pa.record_batch([pa.array([int(own[a])], pa.int32()), pa.array([part.column(name).to_pylist()], pa.list_(pa.int64())), flat], ["list", f"{name}s", f"{name}_vecs"])

        dealt = rows.select("list", name, "vec").repartition("list", F.pmod(F.xxhash64(name), F.lit(SPREAD))).sortWithinPartitions("list", name)
        return dealt.mapInArrow(run, f"list int, {name}s array<long>, {name}_vecs array<double>")

    def _compared(self, near: DataFrame, k: int) -> DataFrame:
        """(query, id, d): the k nearest of each pair of blocks."""
        width = self.centres.shape[1]

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, queries = (np.asarray(batch.column(c)[r].values) for c in ("ids", "querys"))
                    v, q = (np.asarray(batch.column(c)[r].values).reshape(-1, width) for c in ("id_vecs", "query_vecs"))
                    for query, id_, d in nearest(queries, q, ids, v, k):
                        yield pa.record_batch([pa.array(query), pa.array(id_), pa.array(d)], ["query", "id", "d"])

        # not broadcast: Spark sees the queries' size, of which every list that a query probes gets a copy
        pairs = self._packed(self.rows(), "id").join(self._packed(near, "query").hint("merge"), "list")
        return pairs.mapInArrow(run, "query long, id long, d double")

    def search(self, queries: DataFrame, k: int, probes: int, exact: bool = True) -> DataFrame:
        """(query, id, score): the k nearest rows of every row of queries (query, embedding), by the probes nearest lists, and exactly by all lists that can hold a nearer one."""
        if self.centres is None or not self.segments:
            return self.spark.createDataFrame([], "query long, id long, score double")
        asked = cut(queries.select(F.col("query").cast("long").alias("query"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == self.centres.shape[1]))
        found = cut(self._compared(self._near(asked, np.zeros(1), probes, False), k))
        by = Window.partitionBy("query").orderBy("d", "id")
        if exact:
            radius = np.full(len(self.centres), -np.inf)
            for r in self.rows().groupBy("list").agg(F.max("dist").alias("r")).collect():  # one row a list
                radius[r["list"]] = r["r"]
            kth = found.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("query", "d")
            bound = asked.join(kth, "query", "left").withColumn("d", F.coalesce("d", F.lit(float("inf"))))
            found = found.unionByName(self._compared(self._near(bound, radius, probes, True), k))
        score = F.round(F.greatest(F.lit(0.0), 1 - F.col("d") * F.col("d") / 2), 6)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return found.select("query", "id", score.alias("score")).withColumn("n", place).where(F.col("n") <= k).drop("n")
