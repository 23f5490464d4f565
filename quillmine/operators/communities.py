"""Communities of an undirected graph by distributed local moving, their members, and modularity in whole numbers.

A sweep is a handful of joins over all nodes. Every node sums its edges into each neighbouring community and picks the
move of largest modularity gain; gains are whole numbers (times m2**2 / 2, m2 being the sum of degrees), so they are
exact. Moves that would spoil each other are kept apart: a community either gives or takes in one sweep, whichever its
best move asks for, and a move is made only if its gain is larger than what all moves before it that leave the same
community or enter the same one could cost it (their degrees times its own). So modularity rises with every sweep that
moves anything, whatever the partitioning; the best move of all is always made. Sweeps end when no gain is left.

Nodes are dealt over groups of about ARCS arcs. A group keeps the packed arcs of its nodes, is sent the communities that
these arcs lead to, packed as well, and finds its nodes' best moves by one sort; no task holds more than its own arcs and
their ends, so a single node's neighbours must fit one. Where whole numbers would not fit 64 bits, moves come from joins.

Cases: edges are undirected, repeated edges count once, loops and null ends not at all; a node without an edge is in no
community; an empty graph gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import ARCS, cut, reverse

SWEEPS, LEAST, MOST = 20, 3, 50
#: Parts of one community's moves, so that a hub's are not ordered in one task.
PARTS = 32
#: Arcs of a group at least, where there are cores left, and arcs of one packed row.
FEW, ROW = 1 << 16, 1 << 16
#: Bound of the sum of degrees times the largest, for gains in 64 bits.
LARGE = 1 << 61
_WIDE = "decimal(38,0)"


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, without loops."""
    plain = edges.select("src", "dst").where("src <> dst")
    return plain.unionByName(reverse(plain)).distinct()


def _wide(x: str) -> Column:
    return F.col(x).cast(_WIDE)


def _before(moves: DataFrame) -> DataFrame:
    """moves with before: the degrees of the moves ordered before each, by part and node, in the community it leaves and in the one it enters."""
    both = F.explode(F.array("origin", "target")).alias("community")  # no community gives and takes
    ends = moves.select("node", "d", "target", "gain", "part", both)
    total = ends.groupBy("community", "part").agg(F.sum("d").alias("sum"))
    w = Window.partitionBy("community").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("community", "part", F.coalesce(F.sum("sum").over(w), F.lit(0)).alias("parts_before"))
    own = Window.partitionBy("community", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = ends.join(total, ["community", "part"]).withColumn("before", F.col("parts_before") + F.coalesce(F.sum("d").over(own), F.lit(0)))
    return placed.groupBy("node", "d", "target", "gain").agg(F.sum("before").alias("before"))


def best_moves(both: DataFrame, state: DataFrame, m2: int) -> DataFrame:
    """(node, d, origin, target, gain): every node's best move among those that gain; equal gains go to the smallest community."""
    degrees = state.groupBy("community").agg(F.sum("d").alias("total"))
    votes = both.join(state.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("k"))
    seen = votes.join(degrees, "community").withColumnRenamed("src", "node")
    own = state.withColumnRenamed("community", "origin").join(degrees.toDF("origin", "own_total"), "origin")
    other = F.col("community") != F.col("origin")
    value = _wide("k") * F.lit(m2).cast("decimal(19,0)") - _wide("d") * _wide("total")
    ranked = seen.join(own, "node").groupBy("node", "d", "origin", "own_total").agg(
        F.max(F.when(other, F.struct(value.alias("value"), (-F.col("community")).alias("least")))).alias("best"),
        F.coalesce(F.max(F.when(~other, F.col("k"))), F.lit(0)).alias("stay"),
    )
    gain = F.col("best.value") - (_wide("stay") * F.lit(m2).cast("decimal(19,0)") - _wide("d") * (_wide("own_total") - _wide("d")))
    return ranked.select("node", "d", "origin", (-F.col("best.least")).alias("target"), gain.alias("gain")).where("gain > 0")


def _bytes(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(c, np.int64).tobytes()], pa.binary()) for c in columns]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _pack_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, src, dst) with arcs as bytes."""
    kept, size = [], 0

    def packed(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        group, src, dst = np.hstack(kept)
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            yield pa.record_batch([pa.array([group[own[0]]], pa.int32()), *_bytes([src[own], dst[own]])], ["group", "src", "dst"])

    for batch in batches:
        if batch.num_rows:
            kept.append(np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("group", "src", "dst")]))
            size += batch.num_rows
        if size >= ROW:
            yield from packed(kept)
            kept, size = [], 0
    if size:
        yield from packed(kept)


def _pack_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, node, community, total) as bytes, once for every group that wants the node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        wants = batch.column("wants")
        group, owner = wants.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), wants.value_lengths().to_numpy())
        order = np.argsort(group, kind="stable")
        columns = [batch.column(n).to_numpy() for n in ("node", "community", "total")]
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            yield pa.record_batch([pa.array([group[own[0]]], pa.int32()), *_bytes([c[owner[own]] for c in columns])], ["group", "node", "community", "total"])


def _best(m2: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(arcs: pa.Table, states: pa.Table) -> pa.Table:
        src, dst = _numbers(arcs["src"]), _numbers(arcs["dst"])
        node, community, total = (_numbers(states[n]) for n in ("node", "community", "total"))
        order = np.argsort(node)
        node, community, total = node[order], community[order], total[order]
        names, first, place = np.unique(community, return_index=True, return_inverse=True)
        totals = total[first]
        start, end = np.searchsorted(node, src), np.searchsorted(node, dst)
        keys, k = np.unique(start * len(names) + place[end], return_counts=True)
        start, place_to = np.divmod(keys, max(len(names), 1))
        own, begin = np.unique(start, return_index=True)  # in order
        of = np.repeat(np.arange(len(own)), np.diff(np.append(begin, len(start))))
        d = np.add.reduceat(k, begin) if len(own) else k
        home = place[own]
        stays = place_to == home[of]
        stay = np.zeros(len(own), np.int64)
        stay[of[stays]] = k[stays]
        value = k * m2 - d[of] * totals[place_to]
        stay = stay * m2 - d * (totals[home] - d)
        # communities are in order within a node, so the first of the largest values has the smallest
        value = np.where(stays, np.iinfo(np.int64).min, value)
        most = np.maximum.reduceat(value, begin) if len(own) else value
        top = np.flatnonzero((value == most[of]) & ~stays)
        mine, at = np.unique(of[top], return_index=True)
        gain = most[mine] - stay[mine]
        good = gain > 0
        mine, target = mine[good], names[place_to[top[at[good]]]]
        return pa.table({"node": node[own[mine]], "d": d[mine], "origin": names[home[mine]], "target": target, "gain": gain[good]})

    return run


class _Dealt:
    """Arcs dealt over groups by their first ends, and which groups want each node."""

    def __init__(self, both: DataFrame, arcs: int):
        cores = both.sparkSession.sparkContext.defaultParallelism
        self.groups = max(arcs // ARCS + 1, min(cores, arcs // FEW + 1))
        group = F.pmod(F.xxhash64("src"), F.lit(self.groups)).cast("int").alias("group")
        given = both.select(group, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        self.packed = cut(given.repartition(2 * self.groups, "group").mapInArrow(_pack_arcs, "group int, src binary, dst binary"))
        # arcs go both ways, so a node is wanted where its neighbours are, and in its own group
        ends = given.select(F.col("dst").alias("node"), "group").unionByName(given.select(F.col("src").alias("node"), "group"))
        self.wants = cut(ends.groupBy("node").agg(F.collect_set("group").alias("wants")))

    def best_moves(self, state: DataFrame, m2: int) -> DataFrame:
        """best_moves(), by groups."""
        degrees = state.groupBy("community").agg(F.sum("d").alias("total"))
        sent = state.join(degrees, "community").select(F.col("node").cast("long").alias("node"), F.col("community").cast("long").alias("community"), "total").join(self.wants, "node")
        sent = sent.mapInArrow(_pack_state, "group int, node binary, community binary, total binary")
        left, right = (df.repartition(2 * self.groups, "group").groupBy("group") for df in (self.packed, sent))
        found = left.cogroup(right).applyInArrow(_best(m2), "node long, d long, origin long, target long, gain long")
        kind = state.schema["node"].dataType
        return found.select(*[F.col(n).cast(kind).alias(n) if n in ("node", "origin", "target") else n for n in ("node", "d", "origin", "target")], _wide("gain").alias("gain"))


def sweep(moves: DataFrame) -> DataFrame:
    """(node, target) of the moves that can be made together."""
    strength = F.struct("gain", "node")
    ends = moves.select(F.col("origin").alias("community"), strength.alias("out"), F.lit(None).alias("into")).unionByName(
        moves.select(F.col("target").alias("community"), F.lit(None).alias("out"), strength.alias("into"))
    )
    roles = ends.groupBy("community").agg(F.max("out").alias("out"), F.max("into").alias("into"))
    gives = F.col("into").isNull() | (F.col("out").isNotNull() & (F.col("out") > F.col("into")))
    roles = roles.select("community", gives.alias("gives"), F.col("out.node").alias("first_out"), F.col("into.node").alias("first_in"))
    pairs = moves.join(roles.where("gives").select(F.col("community").alias("origin"), "first_out"), "origin")
    pairs = pairs.join(roles.where("not gives").select(F.col("community").alias("target"), "first_in"), "target")
    first = (F.col("node") == F.col("first_out")) & (F.col("node") == F.col("first_in"))
    pairs = pairs.select("node", "d", "origin", "target", "gain", F.when(first, -1).otherwise(F.pmod(F.xxhash64("node"), F.lit(PARTS))).cast("int").alias("part"))
    return _before(pairs).where(F.col("gain") > _wide("d") * _wide("before")).select("node", "target")


def local_moving(edges: DataFrame, sweeps: int = SWEEPS, watch: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(node, d, community) when no move gains, or after so many sweeps; watch sees the state after each."""
    both = cut(undirected(edges))
    state = cut(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")).withColumn("community", F.col("node")))
    m2, most = state.agg(F.sum("d"), F.max("d")).first()
    if not m2 or not sweeps:
        return state
    dealt = _Dealt(both, m2) if m2 * most < LARGE else None
    for _ in range(sweeps):
        moves = cut(dealt.best_moves(state, m2) if dealt else best_moves(both, state, m2))
        if moves.isEmpty():
            break
        made = cut(sweep(moves))
        state = cut(state.join(made, "node", "left").select("node", "d", F.coalesce("target", "community").alias("community")))
        if watch:
            watch(state)
    return state


def named(state: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(node, community, size, degree, kept) of every node: communities are named hub__nN after the node of largest degree (the smallest of equals); those of least to most nodes are kept."""
    hubs = state.groupBy("community").agg(F.max(F.struct("d", (-F.col("node")).alias("least"))).alias("hub"), F.count("*").alias("size"))
    name = F.concat((-F.col("hub.least")).cast("string"), F.lit("__n"), F.col("size").cast("string"))
    return state.join(hubs, "community").select("node", name.alias("name"), "size", F.col("d").alias("degree"), F.col("size").between(least, most).alias("kept")).withColumnRenamed("name", "community")


def quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, inside, total, share): edge ends inside, all edge ends, and the share of modularity of each of labels (node, community)."""
    both = undirected(edges)
    a, b = labels.select(F.col("node").alias("src"), "community"), labels.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    m2 = F.broadcast(both.agg(F.count("*").alias("m2")))  # one row
    ends = both.join(a, "src").join(b, "dst", "left").groupBy("community").agg(F.count_if(F.col("community") == F.col("other")).alias("inside"), F.count("*").alias("total"))
    share = F.col("inside") / F.col("m2") - F.pow(F.col("total") / F.col("m2"), 2)
    return ends.crossJoin(m2).select("community", "inside", "total", (F.round(share, 6) + 0.0).alias("share"))


def members(state: DataFrame, symbols: DataFrame, most: int = MOST) -> DataFrame:
    """(symbol, node, place, size) of each of symbols' (node) communities of named(): the symbol first, then by degree, at most so many."""
    asked = symbols.select(F.col("node").alias("symbol")).join(state.select(F.col("node").alias("symbol"), "community"), "symbol")
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("node") != F.col("symbol"), F.desc("degree"), "node"))
    return asked.join(state, "community").select("symbol", "community", "node", "size", place.alias("place")).where(F.col("place") <= most)
