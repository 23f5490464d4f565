"""Fuzzy names: all pairs whose Ratcliff-Obershelp ratio reaches a threshold, without comparing all pairs.

The ratio is twice the number of characters in matching blocks over the length of both names; blocks are the longest
common run, then, again and again, those to its left and right. If a pair of total length T reaches ratio t, its blocks
hold M >= tT/2 characters, so the bags of characters of the names (the k-th of equal characters counted as one of its
own) differ in T - 2M at most. Every name gets a bitmap of BITS parities of its numbered characters: where bags differ in
so many, the bitmaps do not differ in more bits. There are T - 2M + 1 blocks at most, each with one bigram less than
characters, so the bags of bigrams differ in 3(T - 2M) at most, and PAIRS bits tell that. Names are dealt into blocks, each pair of blocks is one group, and only
numbers, lengths and bitmaps are exchanged. A group compares the names of each length with those whose lengths leave
room, first by 64 bits, then by all; what is left meets its names. Blocks keep their order, so the longest common
subsequence, found for many pairs at once, bounds their characters too (where a name fits in WORD bits), and only where
it suffices are the blocks found, by dynamic programming over runs. Nothing is left out: every filter is a bound that a pair at the threshold meets. All pairs of fitting lengths are
compared in that way, at about a nanosecond or two each, so work grows with their number (linear in one side if the
other stays as it is); a join on rare grams made more candidates of prose, as prose shares its grams.

Cases: null and empty names are left out; equal names are one (a row of their own pair if both sides hold them); length
counts code points; from 200 characters on, those of the second name that make up over a hundredth of it start no run,
as is usual for this ratio. The ratio is not symmetric: the left name is the first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

#: Names of one block at most, bits for a name's characters and for its bigrams, and comparisons made at once.
HOT, BITS, PAIRS, AT_ONCE = 1 << 17, 256, 512, 1 << 17
#: Of second names of this many characters or more, frequent characters start no run.
LONG = 200
#: Characters of a name that are bits of one number.
WORD = 64
EDGE = 1e-9


def _longest(one: str, places: dict[str, list[int]], two: str, box: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """(start in one, start in two, length) of the longest common run within the box; of equals the first in one, then in two."""
    low, high, left, right = box
    at, to, size = low, left, 0
    ends: dict[int, int] = {}
    for i in range(low, high):
        now = {}
        for j in places.get(one[i], ()):
            if left <= j < right:
                now[j] = n = ends.get(j - 1, 0) + 1
                if n > size:
                    at, to, size = i - n + 1, j - n + 1, n
        ends = now
    # characters that start no run may still lengthen one
    while at > low and to > left and one[at - 1] == two[to - 1]:
        at, to, size = at - 1, to - 1, size + 1
    while at + size < high and to + size < right and one[at + size] == two[to + size]:
        size += 1
    return at, to, size


def matched(one: str, two: str) -> int:
    """The number of characters in the matching blocks of two names."""
    places: dict[str, list[int]] = {}
    for j, c in enumerate(two):
        places.setdefault(c, []).append(j)
    if len(two) >= LONG:
        places = {c: js for c, js in places.items() if len(js) <= len(two) // 100 + 1}
    found, boxes = 0, [(0, len(one), 0, len(two))]
    while boxes:
        low, high, left, right = box = boxes.pop()
        at, to, size = _longest(one, places, two, box)
        if size:
            found += size
            boxes += [(low, at, left, to), (at + size, high, to + size, right)]
    return found


def _codes(names: list[str], pad: int) -> np.ndarray:
    """(names, a multiple of 8) code points, filled up with pad."""
    n = np.fromiter(map(len, names), np.int64, len(names))
    out = np.full((len(names), -(-int(n.max(initial=1)) // 8) * 8), pad, np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(names).encode("utf-32-le"), np.int32)
    return out


def in_order(one: list[str], two: list[str]) -> np.ndarray:
    """The longest common subsequence of each pair of names, the first of 1 to WORD characters, by bit-parallel sums. Blocks hold no more characters, as they keep their order."""
    a, b = _codes(one, -1), _codes(two, -2)
    v = np.full(len(one), (1 << 64) - 1, np.uint64)
    same = np.zeros((len(one), 8), np.uint8)
    for j in range(b.shape[1]):
        same[:, : a.shape[1] // 8] = np.packbits(a == b[:, j, None], axis=1, bitorder="little")
        u = v & same.view(np.uint64).ravel()
        v = (v + u) | (v - u)
    own = np.uint64((1 << 64) - 1) >> np.fromiter((WORD - len(x) for x in one), np.uint64, len(one))
    return np.bitwise_count(~v & own).astype(np.int64)


def _likely(one: list[str], two: list[str], threshold: float) -> list[int]:
    """The pairs whose characters in common bound the ratio by threshold or more: those in order, or whatever their order if both names are longer than WORD."""
    short, long = (f(np.fromiter(map(len, one), np.int64, len(one)), np.fromiter(map(len, two), np.int64, len(two))) for f in (np.minimum, np.maximum))
    both = short + long
    out = [k for k in np.flatnonzero(short > WORD).tolist() if 2.0 * (Counter(one[k]) & Counter(two[k])).total() / both[k] >= threshold]
    order = np.flatnonzero(short <= WORD)
    order = order[np.argsort(long[order], kind="stable")]
    at = 0
    while at < len(order):
        widest = int(long[order[min(at + 4096, len(order)) - 1]])
        some = order[at : at + max(1, min(4096, (1 << 19) // widest))]
        pairs = [sorted((one[k], two[k]), key=len) for k in some.tolist()]
        out += some[2.0 * in_order([x for x, _ in pairs], [y for _, y in pairs]) / both[some] >= threshold].tolist()
        at += len(some)
    return out


def _ratios(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            one, two, out = frame["a"].tolist(), frame["b"].tolist(), []
            for k in _likely(one, two, threshold):
                ratio = 2.0 * matched(one[k], two[k]) / (len(one[k]) + len(two[k]))
                if ratio >= threshold:
                    out.append((one[k], two[k], ratio))
            yield pd.DataFrame(out, columns=["a", "b", "ratio"])

    return run


def _parities(owner: np.ndarray, grams: np.ndarray, names: int, bits: int) -> np.ndarray:
    """(names, bits / 64) words: bit h(g, k) is turned for the k-th of every gram g (below 2**42) of a name."""
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    start = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(grams, prepend=-1) != 0))
    nth = np.arange(len(grams)) - np.repeat(start, np.diff(np.append(start, len(grams))))
    mixed = ((grams >> 21) * 0x27D4EB2F + (grams & 0x1FFFFF) * 0x9E3779B1 + nth * 0x85EBCA6B) & 0xFFFFFFFF
    mixed = ((mixed ^ mixed >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
    odd = np.bincount(owner * bits + (mixed >> 12) % bits, minlength=names * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(names, bits // 64)


def bitmaps(names: list[str]) -> np.ndarray:
    """(names, (BITS + PAIRS) / 64) words: parities of each name's numbered characters, then of its numbered bigrams."""
    owner = np.repeat(np.arange(len(names)), np.fromiter(map(len, names), np.int64, len(names)))
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    same = np.flatnonzero(owner[1:] == owner[:-1])
    return np.hstack([_parities(owner, codes, len(names), BITS), _parities(owner[same], codes[same] << 21 | codes[same + 1], len(names), PAIRS)])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("name").to_pylist()
        if names:
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary((BITS + PAIRS) // 8), len(names), [None, pa.py_buffer(bitmaps(names).tobytes())])
            yield pa.record_batch([batch.column("id"), pa.array(list(map(len, names)), pa.int32()), bits.cast(pa.binary())], ["id", "n", "bits"])


def _by_length(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and, by word, bitmaps, shorter names first."""
    n = table["n"].to_numpy()
    order = np.argsort(n, kind="stable")
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(n), (BITS + PAIRS) // 64)
    return table["id"].to_numpy()[order], n[order], np.ascontiguousarray(bits[order].T)


def _candidates(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids_a, na, bits_a), (ids_b, nb, bits_b) = _by_length(left), _by_length(right)
        folded_a, folded_b = (np.bitwise_xor.reduce(bits[: BITS // 64]) for bits in (bits_a, bits_b))  # parities in 64 bits
        out_a, out_b = [ids_a[:0]], [ids_b[:0]]
        for n in np.unique(na) if len(nb) else ():
            first, last = np.searchsorted(na, [n, n + 1])
            both = n + nb
            fits = np.flatnonzero(2 * np.minimum(n, nb) >= threshold * both - EDGE)
            if not len(fits):
                continue
            low, high = fits[0], fits[-1] + 1
            # characters outside the blocks, at most
            spare = (both - 2 * np.ceil(threshold / 2 * both - EDGE).astype(np.int64))[low:high]
            near, some = np.minimum(spare, 64).astype(np.uint8), folded_b[low:high]
            step = max(AT_ONCE // (high - low), 1)
            for k in range(first, last, step):
                left_over = np.flatnonzero(np.bitwise_count(folded_a[k : min(k + step, last), None] ^ some) <= near)
                for m in range(0, len(left_over), AT_ONCE):
                    x, y = np.divmod(left_over[m : m + AT_ONCE], high - low)
                    for words, most in ((range(BITS // 64), spare), (range(BITS // 64, len(bits_a)), 3 * spare)):
                        differ = np.zeros(len(x), np.int16)
                        for w in words:
                            differ += np.bitwise_count(bits_a[w][k + x] ^ bits_b[w][low + y])
                            good = np.flatnonzero(differ <= most[y])
                            x, y, differ = x[good], y[good], differ[good]
                    out_a.append(ids_a[k + x]), out_b.append(ids_b[low + y])
        return pa.table({"ia": np.concatenate(out_a), "ib": np.concatenate(out_b)})

    return run


def close_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b, ratio) of all names a of left and b of right (name) with a ratio of threshold or more; without right, of all a < b of left."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0, up to 1")
    bare = lambda df: cut(df.select("name").where("name <> ''").distinct().withColumn("id", F.monotonically_increasing_id()))
    one = bare(left)
    two = one if right is None else bare(right)
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    n_one, n_two = one.count(), two.count()
    # so many blocks that none is larger than HOT and all cores have pairs of blocks
    parts_b = max(-(-n_two // HOT), min(n_two // 1000, math.isqrt(tasks)), 1)
    parts_a = parts_b if right is None else max(-(-n_one // HOT), min(n_one // 1000, tasks // parts_b), 1)
    marked = lambda df: cut(df.mapInArrow(_marked, "id long, n int, bits binary"))
    mine = marked(one)
    other = mine if right is None else marked(two)
    block = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    every = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long")))
    a = mine.withColumn("x", block(parts_a)).withColumn("y", every(parts_b))
    b = other.withColumn("y", block(parts_b)).withColumn("x", every(parts_a))
    if right is None:
        a, b = a.where("x <= y"), b.where("x <= y")
    a, b = (df.repartition(min(parts_a * parts_b, 8 * tasks), "x", "y").groupBy("x", "y") for df in (a, b))
    found = cut(a.cogroup(b).applyInArrow(_candidates(threshold), "ia long, ib long"))
    pairs = found.join(one.select(F.col("id").alias("ia"), F.col("name").alias("a")), "ia").join(two.select(F.col("id").alias("ib"), F.col("name").alias("b")), "ib")
    if right is None:
        # a pair within a block comes both ways, a pair of two blocks in one of them
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        pairs = pairs.where("ia <> ib").select(low, high).distinct()
    return pairs.select("a", "b").repartition(tasks).mapInPandas(_ratios(threshold), "a string, b string, ratio double")


def close_matches(words: DataFrame, possible: DataFrame, most: int = 3, threshold: float = 0.6) -> DataFrame:
    """(word, match, ratio, rank) of the most names of possible (name) that are closest to each of words (name), themselves left out; of equals the greater name first."""
    found = close_pairs(possible, words, threshold).where("a <> b")
    # a few rows of each word are kept per task before the window's exchange, as ranks are filtered
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("ratio"), F.desc("a")))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("b").alias("word"), F.col("a").alias("match"), "ratio", "rank")


def resolved(matches: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(word, name) of the words that can be replaced without asking: the closest match, if close enough in the other direction too."""
    nearest = matches.where("rank = 1").select(F.col("word").alias("a"), F.col("match").alias("b"))
    return nearest.mapInPandas(_ratios(threshold), "a string, b string, ratio double").select(F.col("a").alias("word"), F.col("b").alias("name"), "ratio")
