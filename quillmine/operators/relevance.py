"""Relevance of nodes to many seeds at once: walks with restart by forward push, mixed with co-activation.

For every seed there is an estimate p and a residual r by node; in the beginning all of r lies on the seed. A round pushes
every residual above eps times its node's degree: the share restart of it goes to p, the rest to the neighbours'
residuals. What a residual would still add to p is at most itself, so sum |score - p| <= sum r for every seed, and the
sum is given back with the result: the bound is certified, not hoped for. Each push moves restart * eps * degree at least
out of the one unit that a seed has, so a seed touches a number of nodes that eps bounds and the graph's size does not.
A node without a way out keeps its share; the rest of what it is pushed is lost, as the walk ends there.

Seeds do not meet each other, so they are dealt over tasks, and a task runs all rounds of a seed on its own. The arcs lie
in files of the shared folder, ordered by their first end as numbers of nodes; a task maps them and reads what its
seeds' frontiers touch, which are 1 / eps arcs in a round at most. A task holds some 40 bytes for every node of the graph, and
no arcs. Where nodes are too many for that (HELD) or no whole numbers, every round is a join of all seeds' residuals with
the arcs; both ways push the same.

Cases: repeated edges count once; seeds outside the graph give no rows; loops are edges like any other; null ends are none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .graph import ARCS, ROUNDS, _folder, cut, reverse

RESTART, EPS = 0.15, 1e-6
WALK, TOGETHER = 0.6, 0.4
#: Nodes of which a task holds the state, at most, and rows of one batch that it gives, about.
HELD, GIVEN = 1 << 23, 1 << 16


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _mapped(path: str, kind: type) -> np.ndarray:
    """The numbers of a file of the shared folder, not read before they are used where the folder is local."""
    system, at = _system(path)
    if system.type_name != "local":
        with system.open_input_file(at) as data:
            return np.frombuffer(data.read_buffer(), kind)
    return np.memmap(at, kind, "r")


def _written(df: DataFrame, folder: str, columns: list[Callable[[pa.RecordBatch], np.ndarray]]) -> list[tuple]:
    """(first, rows, files) of every partition of df, by first, the least value of its first column, by which they are ordered; one file a column. Attempts of a task write files of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{folder}/{uuid.uuid4().hex}" for _ in columns]
        first, rows, outs = None, 0, []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if first is None:
                    first = batch.column(0)[0].as_py()
                    outs = [system.open_output_stream(at) for system, at in map(_system, names)]
                rows += batch.num_rows
                for out, column in zip(outs, columns):
                    out.write(np.ascontiguousarray(column(batch)).tobytes())
        finally:
            for out in outs:
                out.close()
        if rows:
            yield pa.record_batch([pa.array([first], pa.int64()), pa.array([rows], pa.int64()), pa.array([names])], ["first", "rows", "files"])

    return sorted(tuple(r) for r in df.mapInArrow(run, "first long, rows long, files array<string>").collect())  # a row a partition


class _Graph:
    """Arcs in files: node numbers are places among the nodes in ascending order, an arc is the number of its second end."""

    def __init__(self, arcs: DataFrame, degrees: DataFrame, n_arcs: int, n_nodes: int):
        spark = arcs.sparkSession
        folder = f"{_folder(spark)}/quillmine/arcs-{uuid.uuid4().hex}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        column = lambda name, kind: lambda batch: batch.column(name).to_numpy().astype(kind)
        ordered = degrees.select(F.col("node").cast("long").alias("node"), F.col("d").cast("long").alias("d"))
        ordered = ordered.repartitionByRange(n_nodes // ARCS + 1, "node").sortWithinPartitions("node")
        self.nodes = _written(ordered, folder, [column("node", np.int64), column("d", np.int64)])
        held: list[np.ndarray] = []

        def numbers(batch: pa.RecordBatch) -> np.ndarray:
            if not held:
                held.append(self.ids())
            return np.searchsorted(held[0], batch.column("dst").to_numpy()).astype(np.int32)

        parts = max(n_arcs // ARCS + 1, min(spark.sparkContext.defaultParallelism, n_arcs // (1 << 16) + 1))
        given = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        self.arcs = _written(given.repartitionByRange(parts, "src").sortWithinPartitions("src", "dst"), folder, [numbers])

    def _all(self, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(_mapped(files[k], np.int64) for _, _, files in self.nodes)])

    def ids(self) -> np.ndarray:
        return self._all(0)

    def open(self) -> None:
        """In a task."""
        self.node, self.degree = self.ids(), self._all(1)
        self.first = np.cumsum(self.degree) - self.degree
        self.begins = np.cumsum([0, *(rows for _, rows, _ in self.arcs)])
        self.parts: list[np.ndarray | None] = [None] * len(self.arcs)

    def ends(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Second ends of all arcs of nodes (numbers, ascending), in order, and the degrees of nodes."""
        d = self.degree[nodes]
        places = np.repeat(self.first[nodes] - (np.cumsum(d) - d), d) + np.arange(d.sum())
        bounds = np.searchsorted(places, self.begins)
        out = [np.zeros(0, np.int32)]
        for k in np.flatnonzero(np.diff(bounds)):
            if self.parts[k] is None:
                self.parts[k] = _mapped(self.arcs[k][2][0], np.int32)
            out.append(self.parts[k][places[bounds[k] : bounds[k + 1]] - self.begins[k]])
        return np.concatenate(out), d


def _rounds(graph: _Graph, restart: float, eps: float, keep: Callable[[int, np.ndarray, np.ndarray, list], np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["seed", "node", "score", "bound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = r = place = None
        out, rows = [], 0
        for batch in batches:
            if p is None and batch.num_rows:
                graph.open()
                p, r, place = np.zeros(len(graph.node)), np.zeros(len(graph.node)), np.zeros(len(graph.node), np.int32)
            for k in range(batch.num_rows):
                seed = batch.column("node")[k].as_py()
                now = np.searchsorted(graph.node, [seed])
                r[now] = 1.0
                touched, pushed_ = [now], []
                for _ in range(ROUNDS):
                    now = np.sort(now[r[now] > eps * np.maximum(graph.degree[now], 1)])
                    if not len(now):
                        break
                    pushed = r[now]
                    p[now] += restart * pushed
                    r[now] = 0.0
                    to, d = graph.ends(now)
                    # each end once, without a sort: of those that write to its place one is left
                    turn = np.arange(len(to), dtype=np.int32)
                    place[to] = turn
                    ends = to[place[to] == turn]
                    place[ends] = turn[: len(ends)]
                    share = (1 - restart) / np.maximum(d, 1) * pushed
                    r[ends] += np.bincount(place[to], weights=np.repeat(share, d), minlength=len(ends))
                    pushed_.append(now)
                    touched.append(ends)
                    now = ends
                else:
                    raise RuntimeError(f"no end after {ROUNDS} rounds")
                found = np.unique(np.concatenate([np.zeros(0, np.int64), *pushed_]))
                at = np.unique(np.concatenate(touched))
                bound, node, score = r[at].sum(), graph.node[found], p[found]
                p[found] = r[at] = 0.0
                if keep:
                    left = keep(seed, node, score, batch.column("also")[k].as_py() or [])
                    node, score = node[left], score[left]
                out.append((np.full(len(node), seed, np.int64), node, score, np.full(len(node), bound)))
                rows += len(node)
                if rows >= GIVEN:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                    out, rows = [], 0
        if rows:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return run


def _leading(best: int) -> Callable[[int, np.ndarray, np.ndarray, list], np.ndarray]:
    """Which rows of a seed cluster() can want: the best by walk alone, rounded as there, equals included as far as rounding is open, those in also, and the seed.

    What co-activation adds is not negative, so a row that so many others precede by walk alone and that it adds nothing to stays behind them.
    """

    def keep(seed: int, node: np.ndarray, score: np.ndarray, also: list) -> np.ndarray:
        scaled = WALK * score * 1e4 + 0.5
        low, high = np.floor(scaled - 1e-6), np.floor(scaled + 1e-6)
        other = node != seed
        left = np.isin(node, also) | ~other
        if other.sum() <= best:
            return left | other
        last = np.lexsort((node[other], -low[other]))[best - 1]
        least, border = low[other][last], node[other][last]
        return left | (high > least) | ((high == least) & (node <= border))

    return keep


def walks(edges: DataFrame, seeds: DataFrame, restart: float = RESTART, eps: float = EPS, best: int | None = None) -> DataFrame:
    """(seed, node, score, bound): scores of walks with restart from each of seeds (node); bound is what all scores of the seed lack at most, together.

    With best, seeds have also, an array of nodes, and rows that cluster() does not want of so many may be left out.
    """
    arcs = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    degree = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    nodes = degree.unionByName(arcs.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("d")))
    degrees = cut(nodes.groupBy("node").agg(F.max("d").alias("d")))
    asked = seeds.select("node", "also").dropDuplicates(["node"]) if best else seeds.select("node").distinct()
    start = cut(asked.join(degrees, "node"))
    n_arcs, n_nodes, n_seeds = arcs.count(), degrees.count(), start.count()
    kind = arcs.schema["src"].dataType
    if n_nodes <= HELD and isinstance(kind, IntegralType):
        tasks = max(min(n_seeds, 4 * edges.sparkSession.sparkContext.defaultParallelism), 1)
        given = start.select(F.col("node").cast("long").alias("node"), *(["also"] if best else [])).repartition(tasks, "node")
        found = given.mapInArrow(_rounds(_Graph(arcs, degrees, n_arcs, n_nodes), restart, eps, _leading(best) if best else None), "seed long, node long, score double, bound double")
        return found.select(F.col("seed").cast(kind).alias("seed"), F.col("node").cast(kind).alias("node"), "score", "bound")
    arcs = cut(arcs.join(degree.withColumnRenamed("node", "src"), "src"))
    state = cut(start.select(F.col("node").alias("seed"), "node", "d", F.lit(0.0).alias("p"), F.lit(1.0).alias("r")))
    pushed = F.col("r") > eps * F.greatest("d", F.lit(1))
    for _ in range(ROUNDS):
        now = state.where(pushed)
        if now.isEmpty():
            break
        flow = now.select("seed", F.col("node").alias("src"), "r").join(arcs, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.sum((1 - restart) * F.col("r") / F.col("d")).alias("more"))
        flow = flow.join(degrees, "node")
        own = state.select("seed", "node", "d", (F.col("p") + F.when(pushed, restart * F.col("r")).otherwise(0.0)).alias("p"), F.when(pushed, 0.0).otherwise(F.col("r")).alias("r"))
        both = own.unionByName(flow.select("seed", "node", "d", F.lit(0.0).alias("p"), F.col("more").alias("r")))
        state = cut(both.groupBy("seed", "node").agg(F.max("d").alias("d"), F.sum("p").alias("p"), F.sum("r").alias("r")))
    else:
        raise RuntimeError(f"no end after {ROUNDS} rounds")
    left = state.groupBy("seed").agg(F.sum("r").alias("bound"))
    return state.where("p > 0").join(left, "seed").select("seed", "node", F.col("p").alias("score"), "bound")


def cluster(edges: DataFrame, seeds: DataFrame, together: DataFrame, budget: int = 10, eps: float = EPS) -> DataFrame:
    """(seed, node, place, score, walk, npmi): the budget most relevant nodes of each seed over edges in both directions; together (a, b, npmi) has each pair of nodes once."""
    both = edges.select("src", "dst").unionByName(reverse(edges))
    pairs = together.select(F.col("a").alias("seed"), F.col("b").alias("node"), "npmi").unionByName(together.select(F.col("b").alias("seed"), F.col("a").alias("node"), "npmi"))
    pairs = cut(pairs.join(seeds.select(F.col("node").alias("seed")), "seed", "left_semi"))
    also = pairs.groupBy(F.col("seed").alias("node")).agg(F.collect_list("node").alias("also"))
    asked = seeds.select("node").join(also, "node", "left")
    walk = cut(walks(both, asked, eps=eps, best=budget).select("seed", "node", F.col("score").alias("walk")))
    pairs = pairs.join(walk.where("seed = node").select("seed"), "seed", "left_semi")
    mixed = walk.join(pairs, ["seed", "node"], "full").where("seed <> node")
    # -1 .. 1 becomes 0 .. 1; what is not above 0 counts nothing
    share = F.when(F.col("npmi") > 0, (F.col("npmi") + 1) / 2).otherwise(0.0)
    score = WALK * F.coalesce("walk", F.lit(0.0)) + TOGETHER * share
    rows = mixed.select("seed", "node", F.round(score, 4).alias("score"), F.round("walk", 4).alias("walk"), "npmi")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "node"))
    return rows.withColumn("place", place).where(F.col("place") <= budget)
