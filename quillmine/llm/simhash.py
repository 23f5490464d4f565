"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, each set if it is set in over half the XXH64 hashes (seed 42) of the text's 3-word
shingles. Equal fingerprints become one before anything else. The anchors are the words of a covering code: the
product of four [15,11] Hamming codes, a [3,1] repetition code and a free bit, all perfect, with covering radius 5.
Fingerprints within the threshold t have a middle that differs from either in at most r = ceil(t / 2) bits, and the
middle's anchor is within the covering radius of it; so a fingerprint is replicated to the anchors of all words
within r bits: those within covering radius plus r that can matter (31 for t = 2). Fingerprints that share an
anchor are compared there. An anchor with more than CROWD fingerprints is not compared in pairs: its members are dealt
to all words within r bits, and two are within 2r of each other exactly where such a word is common to both (for an
odd t, which is below 2r, the comparison in blocks stays).

Cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows share their class;
rows with a null doc_id get a fingerprint and the class of the smallest doc_id of their component; an empty table
gives an empty result. Further columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, carrying, checked_broadcast, joined, light_batches, park, texts, word_bounds
from .components import components, forest

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: Fingerprints of an anchor that are compared in pairs.
CROWD = 512
#: Bit ranges (first, length) of the code's factors; lengths are one less than a power of two.
FACTORS = ((0, 15), (15, 15), (30, 15), (45, 15), (60, 3), (63, 1))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(words: bytes, starts: np.ndarray, ends: np.ndarray) -> int:
    """Of words joined by single spaces, word k at starts[k]:ends[k]."""
    n = len(starts)
    if not n:
        return 0
    k = min(SHINGLE, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(words[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * total > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs, and fp (the fingerprint's bits as a signed long)."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = texts(batch.column(len(keep)))
            flat = _LOWER[flat]
            out = np.zeros(batch.num_rows, np.uint64)
            for a, b in blocks(offsets):
                part, edges = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = word_bounds(part, edges)
                line = joined(part, starts, ends)
                stop = np.cumsum(ends - starts) + np.arange(len(starts))
                start = stop - (ends - starts)
                for row in range(b - a):
                    i, j = first[row], first[row + 1]
                    if j > i:
                        own = line[start[i] : stop[j - 1]]
                        out[a + row] = fingerprint(own, start[i:j] - start[i], stop[i:j] - start[i])
            fields = [batch.schema.field(i) for i in range(len(keep))]
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(out.view(np.int64))], schema=pa.schema([*fields, ("fp", pa.int64())]))

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def anchors(word: np.ndarray) -> np.ndarray:
    """The nearest code word of each 64-bit word. A factor of length 2**m - 1 has as syndrome the XOR of the places (from 1) of its set bits; flipping the bit there gives its code word."""
    out = word.copy()
    for first, length in FACTORS:
        if length == 1:
            continue
        syndrome = np.zeros(len(word), np.uint64)
        for place in range(1, length + 1):
            syndrome ^= ((word >> np.uint64(first + place - 1)) & np.uint64(1)) * np.uint64(place)
        flip = syndrome > 0
        out[flip] ^= np.uint64(1) << (np.uint64(first) + syndrome[flip] - np.uint64(1))
    return out


def near(word: np.ndarray, radius: int) -> np.ndarray:
    """All words within radius bits of each; (n, number of them)."""
    masks = [0] + [reduce(lambda a, b: a | b, (1 << k for k in ks)) for r in range(1, radius + 1) for ks in combinations(range(64), r)]
    return word[:, None] ^ np.array(masks, np.uint64)[None, :]


def replicas(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(anchor, fp) for fps (fp: long, distinct)."""
    radius = -(-threshold // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                own = fp[at : at + 4096]
                middle = near(own, radius)
                anchor = np.sort(anchors(middle.ravel()).reshape(middle.shape), axis=1)
                new = np.ones(anchor.shape, bool)
                new[:, 1:] = anchor[:, 1:] != anchor[:, :-1]
                row, column = np.nonzero(new)
                yield pa.record_batch([pa.array(anchor[row, column].view(np.int64)), pa.array(own[row].view(np.int64))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def _compare(members: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links among members, found block by block."""
    found = []
    for at in range(0, len(members), 256):
        part = members[at : at + 256]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ members[None, at:]) <= threshold)
        keep = i < j
        found.append((part[i[keep]].view(np.int64), members[at:][j[keep]].view(np.int64)))
    a, b = (np.concatenate(x) for x in zip(*found))
    return forest(a, b) if len(a) else (a, b)


def links(fps: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fps within threshold bits."""
    dealt = replicas(fps, threshold).repartition("anchor").sortWithinPartitions("anchor")
    radius = -(-threshold // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams over groups; kind 0 is an edge, kind 1 a (middle, fingerprint) of a crowded anchor."""
        held, before, many = np.zeros(0, np.uint64), None, False

        def deal(members: np.ndarray) -> pa.RecordBatch:
            middle = near(members, radius)
            row = np.repeat(members, middle.shape[1])
            return pa.record_batch([pa.array(middle.ravel().view(np.int64)), pa.array(row.view(np.int64)), pa.array(np.ones(len(row), np.int32))], ["a", "b", "kind"])

        def close(members: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
            return _compare(members, threshold) if len(members) > 1 else None

        for batch in batches:
            anchor, fp = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
            size = np.diff(edges)
            found = []
            for k in np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1)):
                a, b = edges[k], edges[k + 1]
                if anchor[a] != before:
                    if not many and (new := close(held)):
                        found.append(new)
                    held, before, many = np.zeros(0, np.uint64), anchor[a], False
                held = np.concatenate([held, fp[a:b]])
                if threshold % 2 == 0 and (many or len(held) > crowd):
                    many = True
                    for at in range(0, len(held), 1024):
                        yield deal(held[at : at + 1024])
                    held = np.zeros(0, np.uint64)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32))], ["a", "b", "kind"])
        if not many and (new := close(held)):
            yield pa.record_batch([pa.array(new[0]), pa.array(new[1]), pa.array(np.zeros(len(new[0]), np.int32))], ["a", "b", "kind"])

    rows = park(dealt.mapInArrow(run, "a long, b long, kind int"), "links")
    meet = rows.where("kind = 1").select(F.col("a").alias("middle"), F.col("b").alias("fp")).distinct()
    # at most 65 fingerprints lie within one bit of a middle, and any two of them are linked
    star = meet.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    star = star.select(F.explode(F.slice("fps", F.lit(2), F.size("fps") - 1)).alias("a"), F.element_at("fps", 1).alias("b"))
    return rows.where("kind = 0").select("a", "b").unionByName(star)


def classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    with light_batches(docs.sparkSession):
        rows = park(fingerprints(docs, "doc_id"), "fingerprints")
    fps = park(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = park(components(links(fps, threshold)), "roots")
    labelled = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


@carrying("doc_id", "text")
def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return keep_smallest(docs, classes(docs, threshold))


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each class of found (doc_id, component_id): that of the smallest doc_id, and one only if rows repeat it. Rows with a null doc_id cannot be told apart and stay."""
    rows = park(found.where("doc_id IS NOT NULL"), "classes")
    gone = park(rows.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    twice = park(rows.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__gone")).agg(F.count("*").alias("n")).where("n > 1").select("__gone"), "twice")
    out = docs.join(checked_broadcast(gone.unionByName(twice)), F.col("doc_id") == F.col("__gone"), "left_anti")
    if twice.isEmpty():
        return out
    again = docs.join(checked_broadcast(twice), F.col("doc_id") == F.col("__gone"), "left_semi")
    return out.unionByName(again.dropDuplicates(["doc_id"]))
