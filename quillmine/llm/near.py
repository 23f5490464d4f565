"""Near-duplicate texts: Jaccard similarity of the sets of 5-word shingles, THRESHOLD or more, found exactly.

Texts are folded and split as for the fingerprints; a text of fewer words is one shingle, and one without words an
empty set. Shingles are 64-bit hashes. Equal sets are one node before anything else. Prefix filter: shingles have one
order, and two sets that similar share one of the first size - ceil(THRESHOLD * size) + 1 of both, so candidates
meet at a shingle. Any order is exact; shingles that a sample of documents shows to be common come last, so that a
common passage brings few candidates. Each set has a bitmap of the parities of its shingles by their lower bits, at
least as wide as the set is large; two bitmaps, the wider one folded, differ in no more bits than the sets differ in
shingles, so candidates that differ in too many bits are told apart exactly, without their sets. The rest, of fitting
sizes, are verified on their whole sets, as 32-bit hashes (two shingles of a pair that share one, about once in
10,000 pairs, count as one shingle). A shingle with
more than CROWD nodes is first linked to one of them, while they stream by; shingles that the sample shows to be held
by more than SALT documents are dealt over several tasks, each with a node of its own to link to. Where members are not
in one component then, those outside the largest one are compared with all, in blocks of at most about ROWS sets and
VALUES values; two blocks meet in one task, first by bitmaps, then those that have a possible partner by their sets,
and only a forest of their links leaves.

Cases: null and empty texts are one class; repeated rows share their class; rows with a null doc_id are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from . import simhash
from .common import blocks, carrying, checked_broadcast, discard, light_batches, park, small_batches, sweep, texts, word_bounds
from .components import components, forest
from .hashes import BASES, prefix, ranges, sliding
from .simhash import _LOWER, keep_smallest

SHINGLE = 5
THRESHOLD = 0.8
#: Nodes at a shingle that are compared in pairs without ado.
CROWD = 16
#: One in so many documents is looked at for common shingles; those that so many of them hold are common, at most COMMON.
EVERY, OFTEN, COMMON = 16, 4, 50_000
#: Nodes of a common shingle that meet in one task.
SALT = 4096
#: Sets, and values of sets, in a block of a crowd.
ROWS, VALUES = 2048, 1 << 20
#: Bits of the smallest bitmap.
BITS = 1024


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    flat, offsets = texts(column)
    flat = _LOWER[flat]
    for a, b in blocks(offsets):
        part, edges = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, edges)
        words = ranges(prefix(part, BASES[0]), starts, ends, BASES[0])
        sums = prefix(words, BASES[1])
        runs = sliding(sums, SHINGLE, BASES[1])
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= SHINGLE:
                yield np.unique(runs[i : j - SHINGLE + 1])
            else:
                yield ranges(sums, np.array([i]), np.array([j]), BASES[1]) if j > i else np.zeros(0, np.uint64)


def node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def head(shingles: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    n = len(shingles)
    if not n:
        return shingles
    last = np.isin(shingles, common, assume_unique=True)
    return np.concatenate([shingles[~last], shingles[last]])[: n - int(np.ceil(threshold * n - 1e-9)) + 1]


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the number of shingles with each value of their lower bits."""
    width = max(BITS, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits bitmaps i and j (places, pair by pair) differ, the wider one folded: at most as many as shingles are in one of the two sets only."""
    width = np.array([len(x) // 8 for x in bits], np.int64)
    narrow, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(narrow):
        at = np.flatnonzero(narrow == w)
        used = np.unique(np.concatenate([i[at], j[at]]))
        words = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, w)) for k in used])
        a, b = np.searchsorted(used, i[at]), np.searchsorted(used, j[at])
        step = max(1, (1 << 21) // int(w))
        for k in range(0, len(at), step):
            out[at[k : k + step]] = np.bitwise_count(words[a[k : k + step]] ^ words[b[k : k + step]]).sum(1, dtype=np.int64)
    return out


def _possible(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets i and j of n shingles may be similar enough, by sizes and bitmaps; true of every pair that is."""
    out = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
    i, j = i[out], j[out]
    out[out] = _apart(bits, i, j) <= (1 - threshold) / (1 + threshold) * (n[i] + n[j]) + 1e-6
    return out


def _sketch(docs: DataFrame, common: np.ndarray | None, threshold: float) -> DataFrame:
    """(doc_id, node, n, bits, shingles): the head of each set and its bitmap, or the whole set, as upper halves of the hashes, and no bitmap if common is None."""
    schema = docs.select("doc_id").schema.add("node", "long").add("n", "integer").add("bits", "binary").add("shingles", ArrayType(LongType() if common is not None else IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(shingle_sets(batch.column(1)))
            kept = [np.unique(x >> np.uint64(32)).astype(np.uint32).view(np.int32) if common is None else head(x, common, threshold).view(np.int64) for x in rows]
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([np.zeros(0, np.int32 if common is None else np.int64), *kept])))
            columns = [batch.column(0), pa.array([node(x) for x in rows], pa.int64()), pa.array([len(x) for x in rows], pa.int32()), pa.array([None if common is None else bitmap(x) for x in rows], pa.binary()), lists]
            yield pa.record_batch(columns, ["doc_id", "node", "n", "bits", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _common(docs: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Sorted: shingles that many documents of a sample hold, at most COMMON. They decide on the order only. And those among them for several tasks, with their number."""
    some = _sketch(docs.where(F.xxhash64("doc_id") % EVERY == 0), np.zeros(0, np.uint64), 0.0).select(F.explode("shingles").alias("shingle"))
    with light_batches(docs.sparkSession):
        often = some.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    hot = [(r["shingle"], -(-r["n"] * EVERY // SALT)) for r in often if r["n"] * EVERY > SALT]
    return np.sort(np.array([r["shingle"] for r in often], np.int64).view(np.uint64)), hot


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with one shingle, however the batches cut them; single rows are left out."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = batch.column("shingle").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        if held and held[0]["shingle"][0].as_py() != key[0]:
            if sum(x.num_rows for x in held) > 1:
                yield pa.concat_tables(held)
            held = []
        if len(edges) == 2:
            held.append(table)
            continue
        if held or edges[1] > 1:
            yield pa.concat_tables([*held, table.slice(0, edges[1])])
        for k in np.flatnonzero(np.diff(edges[1:-1]) > 1) + 1:
            yield table.slice(edges[k], edges[k + 1] - edges[k])
        held = [table.slice(edges[-2])]
    if held and sum(x.num_rows for x in held) > 1:
        yield pa.concat_tables(held)


def _keys(rows: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """(shingle, salt, node, n) of the sketch; salt is -1 but for hot (shingle, number of tasks), at most COMMON of them. Equal sets at a hot shingle are one row before they meet."""
    keys = rows.select(F.explode("shingles").alias("shingle"), "node", "n")
    if not hot:
        return keys.select("shingle", F.lit(-1).alias("salt"), "node", "n")
    # as an Arrow table, since a list of tuples is read by Python workers of its own
    shingles, salts = zip(*hot)
    wide = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"shingle": pa.array(shingles, pa.int64()), "salts": pa.array(salts, pa.int32())})))
    cold = keys.join(wide, "shingle", "left_anti").select("shingle", F.lit(-1).alias("salt"), "node", "n")
    salted = keys.distinct().join(wide, "shingle").select("shingle", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node", "n")
    return cold.unionByName(salted)


def _meet(keys: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """(kind, a, b) for keys (shingle, salt, node, n): kind 0 is a candidate pair, kind 1 a (shingle, node) of a crowd, kind 2 a (shingle, node) that one task of a hot shingle linked its members to. At most crowd nodes of a shingle and those of a batch are held."""

    def pairs(nodes: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        fit = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
        return 0, np.minimum(nodes[i], nodes[j])[fit], np.maximum(nodes[i], nodes[j])[fit]

    def batch_of(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        kind = np.concatenate([np.full(len(a), k, np.int32) for k, a, _ in found])
        return pa.record_batch([pa.array(kind), *(pa.array(np.concatenate([x[c] for x in found])) for c in (1, 2))], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, last, centre, nodes, sizes = None, None, None, none, none
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, salt, node, n = (batch.column(c).to_numpy() for c in ("shingle", "salt", "node", "n"))
            edges = np.concatenate([[0], np.flatnonzero((np.diff(shingle) != 0) | (np.diff(salt) != 0)) + 1, [len(node)]])
            length = np.diff(edges)
            length[[0, -1]] = 2
            found = []
            for k in np.flatnonzero((length > 1) | (salt[edges[:-1]] >= 0)):
                part, at = np.unique(node[edges[k] : edges[k + 1]], return_index=True)
                size = n[edges[k] : edges[k + 1]][at]
                now = (shingle[edges[k]], salt[edges[k]])
                if now != key:
                    if centre is None and len(nodes) > 1:
                        found.append(pairs(nodes, sizes, *np.triu_indices(len(nodes), 1)))
                    key, last, centre, nodes, sizes = now, None, None, none, none
                if last is not None and part[0] == last:
                    part, size = part[1:], size[1:]
                    if not len(part):
                        continue
                last = part[-1]
                nodes, sizes = np.concatenate([nodes, part]), np.concatenate([sizes, size])
                if len(nodes) <= crowd and now[1] < 0:
                    continue
                found.append((1, np.full(len(nodes), now[0], np.int64), nodes))
                if centre is None:
                    middle = int(np.argsort(sizes, kind="stable")[len(nodes) // 2])
                    centre = nodes[middle], sizes[middle]
                    nodes, sizes = np.delete(nodes, middle), np.delete(sizes, middle)
                    if now[1] >= 0:
                        found.append((2, np.array([now[0]], np.int64), np.array([centre[0]], np.int64)))
                m = len(nodes)
                found.append(pairs(np.append(nodes, centre[0]), np.append(sizes, centre[1]), np.arange(m), np.full(m, m)))
                nodes, sizes = none, none
            if found:
                yield batch_of(found)
        if centre is None and len(nodes) > 1:
            yield batch_of([pairs(nodes, sizes, *np.triu_indices(len(nodes), 1))])

    dealt = keys.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "node")
    return dealt.mapInArrow(run, "kind int, a long, b long")


def _compare(sets: list[np.ndarray], roots: np.ndarray, threshold: float, most: int = 4 << 20, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of sets of different roots that are similar enough, i among the first left (all if None). Common values are counted from each value's holders, about most at a time."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    left = m if left is None else left
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(column)
    keep = held[column] > 1
    row, column = np.repeat(np.arange(m), sizes)[keep], column[keep]
    holders = row[np.argsort(column, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.where(held > 1, held, 0))])
    work = np.concatenate([[0], np.cumsum(held[column])])
    cut = np.searchsorted(row, np.arange(m + 1))
    found, a = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while a < left:
        b = max(a + 1, min(a + max(1, most // m), left, int(np.searchsorted(work[cut], work[cut[a]] + most, "right")) - 1))
        both, at = np.zeros((b - a) * m, np.int64), int(cut[a])
        while at < cut[b]:
            to = max(at + 1, min(int(cut[b]), int(np.searchsorted(work, work[at] + most, "right")) - 1))
            n = held[column[at:to]]
            place = np.repeat(first[column[at:to]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both += np.bincount(np.repeat((row[at:to] - a) * m, n) + holders[place], minlength=len(both))
            at = to
        both = both.reshape(b - a, m)
        all_ = sizes[a:b, None] + sizes[None, :] - both
        i, j = np.nonzero((both >= threshold * all_ - 1e-6) & (roots[a:b, None] != roots[None, :]))
        later = i + a < j
        found.append((i[later] + a, j[later]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found))


def _deal(members: DataFrame) -> DataFrame:
    """(shingle, node, root, first): members (shingle, node, root, n) of crowds of several roots, dealt to pairs of blocks, whose number takes the place of the shingle.

    The largest root of a crowd has blocks of its own and its members need not meet each other; every other block meets
    all blocks, as the first of the pair or not, and looks within itself where it is the first.
    """
    per = members.groupBy("shingle", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    per = per.groupBy("shingle").agg(F.count("*").alias("roots"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "n", "root")).alias("top"))
    number = lambda rows, n: F.greatest(F.ceil(rows / F.lit(ROWS)), F.ceil(n / F.lit(VALUES)), F.lit(1)).cast("int")
    top = number(F.col("top.rows"), F.col("top.n"))
    rest = number(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n"))
    laid = per.where("roots > 1").select("shingle", F.col("top.root").alias("top"), top.alias("tops"), rest.alias("rests"))
    own = F.when(F.expr("root = top"), F.col("rests") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rests")))
    met = members.join(laid, "shingle").withColumn("own", own.cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, IF(root = top, rests, rests + tops) - 1)"))).where("own <> other")
    return met.select(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("shingle"), "node", "root", F.expr("own < other").alias("first"))


def _survivors(members: DataFrame, threshold: float) -> DataFrame:
    """Those (shingle, node, root, first) of members (with n and bits, too) that may have a partner of another root in their two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            first = np.asarray(group["first"].to_pylist(), bool)
            roots, n, bits = group["root"].to_numpy(), group["n"].to_numpy().astype(np.int64), group["bits"].to_pylist()
            m, own, seen = group.num_rows, np.flatnonzero(first), np.zeros(group.num_rows, bool)
            step = max(1, (1 << 19) // m)
            for k in range(0, len(own), step):
                i, j = np.repeat(own[k : k + step], m), np.tile(np.arange(m), len(own[k : k + step]))
                other = roots[i] != roots[j]
                i, j = i[other], j[other]
                may = _possible(n, bits, i, j, threshold)
                seen[i[may]] = seen[j[may]] = True
            if seen.any():
                yield from group.filter(pa.array(seen)).select(["shingle", "node", "root", "first"]).to_batches()

    dealt = members.select("shingle", "node", "root", "first", "n", "bits").repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(run, "shingle long, node long, root long, first boolean")


def _crowds(members: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) among members (shingle, node, root, first, shingles) of two blocks that no component holds together yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            first = np.asarray(group["first"].to_pylist(), bool)
            order = np.argsort(~first, kind="stable")
            nodes, roots = group["node"].to_numpy()[order], group["root"].to_numpy()[order]
            sets = group["shingles"].to_numpy()
            i, j = _compare([np.asarray(sets[k]) for k in order], roots, threshold, left=int(first.sum()))
            if len(i):
                a, b = forest(nodes[i], nodes[j])
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return members.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD, known: DataFrame | None = None, hot: list[tuple[int, int]] = []) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of sets of threshold or more, and of known (doc_id, component_id); rows is the sketch of docs. Pairs that known joins already are not verified."""
    met = park(_meet(_keys(rows, hot), threshold, crowd), "met", compression="zstd")
    centres = met.where("kind = 2").select("a", "b")
    centres = centres.join(centres.groupBy("a").agg(F.min("b").alias("low")), "a").where("b <> low").select(F.col("low").alias("a"), "b")
    pairs = met.where("kind = 0").select("a", "b").unionByName(centres).distinct()
    given = None
    if known is not None:
        named = park(rows.select("doc_id", "node").join(known.select("doc_id", "component_id").distinct(), "doc_id").select("node", "component_id").distinct(), "named")
        given = named.select(F.col("node").alias("a"), F.xxhash64(F.lit("class"), F.col("component_id")).alias("b"))
        one = named.groupBy("node").agg(F.min("component_id").alias("c"))
        pairs = pairs.join(one.toDF("a", "ca"), "a", "left").join(one.toDF("b", "cb"), "b", "left").where("NOT (ca <=> cb) OR ca IS NULL").select("a", "b")
    pairs = park(pairs, "pairs")
    crowds = park(met.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("node")), "crowds")
    discard(met)
    marks = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowds.select("node")).distinct()
    marks = rows.select("node", "n", "bits", "doc_id").join(marks, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("doc_id"))
    marks = park(marks, "marks", compression="zstd")
    pairs = park(_promising(pairs, marks, threshold), "promising")
    edges = _verified(pairs, _sets(docs, marks, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), threshold), threshold)
    edges = edges if given is None else edges.unionByName(given)
    sweep(docs.sparkSession)
    if crowds.isEmpty():
        return edges
    roots = park(components(edges).withColumnRenamed("node", "__node"), "first")
    members = crowds.join(marks.select("node", "n"), "node").join(roots, F.col("node") == F.col("__node"), "left")
    members = _deal(park(members.select("shingle", "node", F.coalesce("root", "node").alias("root"), "n"), "crowded"))
    with small_batches(docs.sparkSession, 4096):
        members = park(_survivors(members.join(marks.select("node", "n", "bits"), "node"), threshold), "members")
    sweep(docs.sparkSession)
    sets = _sets(docs, marks, members.select("node"), threshold)
    # a set goes to every pair of blocks it is in, so these are taken in as many slices as they hold sets more than once
    slices = -(-members.count() // max(1, sets.count()))
    for k in range(slices):
        some = members.where(F.pmod(F.xxhash64("shingle"), F.lit(slices)) == k)
        with small_batches(docs.sparkSession, 256):
            edges = edges.unionByName(park(_crowds(some.join(sets, "node"), threshold), "crowded"))
        sweep(docs.sparkSession)
    discard(sets)
    return edges


def _promising(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps of marks (node, n, bits) leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")]).astype(np.int64)
            bits = batch.column("ba").to_pylist() + batch.column("bb").to_pylist()
            may = _possible(n, bits, np.arange(m), np.arange(m, 2 * m), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    marks = marks.select("node", "n", "bits")
    both = pairs.join(marks.toDF("a", "na", "ba"), "a").join(marks.toDF("b", "nb", "bb"), "b").select("a", "b", "na", "nb", "ba", "bb")
    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, marks: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """(node, shingles) of the wanted nodes, written: whole sets, from the text of one doc_id each."""
    holders = checked_broadcast(park(marks.select("node", "doc_id").join(wanted.distinct(), "node", "left_semi").select("doc_id").distinct(), "holders"))
    sets = _sketch(docs.join(holders, "doc_id", "left_semi"), None, threshold).select("node", "shingles")
    with light_batches(docs.sparkSession):
        return park(sets.dropDuplicates(["node"]), "sets", compression="zstd")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) are similar enough, written."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("same"))
    return park(both.where(F.col("same") >= F.lit(threshold) * (F.col("n") - F.col("same")) - 1e-9).select("a", "b"), "edges")


def classes(docs: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) for every row of docs with a doc_id; known (doc_id, component_id) joins rows beforehand."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    common, hot = _common(docs)
    with light_batches(docs.sparkSession):
        rows = park(_sketch(docs, common, threshold), "sketch", compression="zstd")
    roots = park(components(links(docs, rows, threshold, crowd, known, hot)), "roots")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    labelled = park(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "labelled")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(labelled.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def joint_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): classes that fingerprints within their threshold and similar sets make together."""
    by_bits = park(simhash.classes(docs).where("doc_id IS NOT NULL").select("doc_id", "component_id"), "bits")
    sweep(docs.sparkSession)
    return classes(docs, known=by_bits)


@carrying("doc_id", "text")
def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id. Rows with a null doc_id stay."""
    return keep_smallest(docs, classes(docs, threshold))


@carrying("doc_id", "text")
def keep_one_jointly(docs: DataFrame) -> DataFrame:
    """keep_one() for the joint classes."""
    return keep_smallest(docs, joint_classes(docs))
