"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A string of LENGTH bytes that occurs twice has the same anchor in both places: the GRAM bytes of least hash in it.
(1) Texts are laid out in shards, and of equal texts only the first is looked at: its copies lose every string. The
anchors' hashes are counted; only anchors that recur can lie in a repeated string. (2) For these, the suffixes that
start at anchors are sorted per task into runs, equal contexts counted once, and exchanged front-coded: of each
suffix the common prefix with the one before, and what follows it. The exchange deals by range of the suffixes' first
GRAM bytes between sampled splitters, so all suffixes of an anchor meet and the buckets follow each other in order.
(3) A bucket's runs are merged by a loser tree whose nodes keep each suffix's common prefix with the last winner: a
longer one wins without a look at the text, and equal ones are compared behind it only. The merged order and its
common prefixes give the classes of equal right contexts at every depth, sorted left contexts those to the left; a
string that starts j bytes before its anchor repeats where both classes at its depths hold two places. (4) An anchor
found more than HOT times would put all its contexts into one bucket; its strings are counted instead one by one, by
128-bit hash, pre-aggregated. (5) The texts are read once more and the covered bytes go. No step exchanges a text.

Cases: null and empty texts have no bytes; texts shorter than LENGTH lose none; rows that repeat each other, with or
without a doc_id, lose every byte if they are that long; an empty table gives an empty result. doc_id, which must be
an integer, is only passed on. Further columns are not read.
"""

from __future__ import annotations

import itertools
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, park, remove_folder, sweep, texts
from .hashes import BASES, minimizers, mix, prefix, ranges, sliding
from .shards import Notes, chosen, firsts, lay_out, pieces, recurring, ship

LENGTH = 200
GRAM = 64
#: Bytes of contexts that a task holds before it writes its runs.
HELD = 48 << 20
#: Places from which on an anchor's strings are counted one by one, and (shard, anchor) pairs for which there is a bucket.
HOT, PER_BUCKET = 4096, 20_000
#: One text in EVERY is looked at for splitters; they decide how even the buckets are, not the result.
EVERY, SPLIT_SAMPLE = 16, 100_000
#: A place is row << ROW_BITS | byte.
ROW_BITS = 45
_REACH = LENGTH - GRAM


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, first, last, hash) of the anchors of all strings of LENGTH bytes in a block; strings first..last (by start) have that anchor."""
    grams = sliding(prefix(flat.astype(np.uint64) + np.uint64(1), BASES[0]), GRAM, BASES[0])
    least = minimizers(grams, _REACH + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= offsets[row + 1])
    row, place = row[start], least[start]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(place))[: len(head)] - 1
    return row[head], place[head], start[head], start[tail], grams[place[head]].view(np.int64)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, which share known bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """Sorted suffixes with their left contexts; front-coded for the exchange."""

    def __init__(self, entries: list[tuple[bytes, bytes, int, int, int, int]]):
        #: (suffix, left, number, copies up to 2, least and most j)
        self.entries = sorted(entries)
        self.shared = [0] + [common(a[0], b[0]) for a, b in itertools.pairwise(self.entries)]

    def pack(self) -> bytes:
        columns = list(zip(*self.entries))
        small = np.array([self.shared, list(map(len, columns[0])), list(map(len, columns[1])), columns[3], columns[4], columns[5]], np.uint8)
        tails = b"".join(e[0][s:] for e, s in zip(self.entries, self.shared))
        data = len(self.entries).to_bytes(4, "little") + small.tobytes() + np.array(columns[2], "<u4").tobytes() + tails + b"".join(columns[1])
        return zstandard.ZstdCompressor(level=1).compress(data)

    @classmethod
    def unpack(cls, data: bytes) -> Run:
        data = zstandard.ZstdDecompressor().decompress(data)
        n = int.from_bytes(data[:4], "little")
        shared, size, left, copies, least, most = np.frombuffer(data, np.uint8, 6 * n, 4).reshape(6, n).tolist()
        number = np.frombuffer(data, "<u4", n, 4 + 6 * n).tolist()
        at = 4 + 10 * n
        behind = at + sum(size) - sum(shared)
        out, suffix = [], b""
        for k in range(n):
            tail = size[k] - shared[k]
            suffix = suffix[: shared[k]] + data[at : at + tail]
            out.append((suffix, data[behind : behind + left[k]], number[k], copies[k], least[k], most[k]))
            at += tail
            behind += left[k]
        run = cls.__new__(cls)
        run.entries, run.shared = out, shared
        return run


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, common prefix with the suffix before) in sorted order, by a loser tree that knows common prefixes."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * size
    suffix: list[bytes | None] = [r.entries[0][0] if r.entries else None for r in runs] + [None] * (size - len(runs))
    known = [0] * size  # each leaf's common prefix with the last winner

    def beats(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix with the winner is noted."""
        x, y = suffix[a], suffix[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = common(x, y, known[a])
        if x[h : h + 1] < y[h : h + 1] or (x[h : h + 1] == y[h : h + 1] and a < b):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    losers, level = [0] * size, list(range(size))
    while len(level) > 1:
        played = [beats(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        for k, (_, lost) in enumerate(played):
            losers[len(played) + k] = lost
        level = [won for won, _ in played]
    winner = level[0]
    while suffix[winner] is not None:
        run = runs[winner]
        yield winner, at[winner], known[winner]
        at[winner] += 1
        if at[winner] < len(run.entries):
            suffix[winner], known[winner] = run.entries[at[winner]][0], run.shared[at[winner]]
        else:
            suffix[winner] = None
        node = (winner + size) >> 1
        while node:
            winner, losers[node] = beats(winner, losers[node])
            node >>= 1


def repeated(runs: list[Run]) -> Iterator[tuple[int, int, int, int]]:
    """(run, number, from, to): bytes relative to the anchor, behind and before which repeated strings of LENGTH bytes start and end."""
    order = list(merge(runs))
    entries = [runs[r].entries[k] for r, k, _ in order]
    shared = np.array([h for _, _, h in order])
    copies = np.array([e[3] for e in entries])
    group = np.cumsum(shared < GRAM)
    busy = np.flatnonzero(np.bincount(group, copies)[group] > 1)
    if not len(busy):
        return
    # a whole group stays or goes, so that the common prefixes in the rest still hold
    entries, shared, copies = [entries[k] for k in busy], shared[busy].copy(), copies[busy]
    shared[np.flatnonzero(np.diff(group[busy], prepend=-1))] = 0
    size = np.array([len(e[0]) for e in entries])
    least, most = np.array([e[4] for e in entries]), np.array([e[5] for e in entries])
    back = [e[1][::-1] for e in entries]
    by = sorted(range(len(back)), key=back.__getitem__)
    left = np.array([0] + [common(back[a], back[b]) for a, b in itertools.pairwise(by)])
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    found = np.zeros((len(entries), _REACH + 1), bool)
    for j in range(_REACH + 1):
        use = np.flatnonzero((least <= j) & (j <= most))
        if len(use):
            key = np.cumsum(shared < LENGTH - j)[use] * (len(by) + 1) + np.cumsum(left < j)[place[use]]
            _, inverse = np.unique(key, return_inverse=True)
            found[use, j] = np.bincount(inverse, copies[use])[inverse] > 1
    step = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
    for (k, a), (_, b) in zip(np.argwhere(step == 1).tolist(), np.argwhere(step == -1).tolist()):
        yield order[busy[k]][0], entries[k][2], -(b - 1), LENGTH - a


def recurring_rows(piece: pa.RecordBatch, first: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, bytes, list[int], list[int], list[int]]]:
    """(row, text, places, first and last string) of the wanted anchors, for each first text of a piece that has any."""
    part = chosen(piece, first)
    flat, offsets = texts(part.column("text"))
    row, place, since, until, gram = anchors(flat, offsets)
    keep = np.flatnonzero(np.isin(gram, wanted))
    cut = np.searchsorted(row[keep], np.arange(part.num_rows + 1))
    numbers = part.column("row").to_pylist()
    for k in np.flatnonzero(np.diff(cut)).tolist():
        m, base = keep[cut[k] : cut[k + 1]], offsets[k]
        yield numbers[k], flat[base : offsets[k + 1]].tobytes(), (place[m] - base).tolist(), (since[m] - base).tolist(), (until[m] - base).tolist()


def splitters(laid: DataFrame, first: str, grams: str, buckets: int) -> list[bytes]:
    """Sorted first bytes of sampled suffixes, fewer than buckets: at most SPLIT_SAMPLE rows of GRAM bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Notes(first), Notes(grams)
        for shard, piece in pieces(batches):
            if len(some := known.longs(shard)):
                heads = [text[p : p + GRAM] for _, text, place, _, _ in recurring_rows(piece, own.longs(shard), some) for p in place]
                yield pa.record_batch([pa.array(heads, pa.binary())], ["head"])

    some = laid.where(F.pmod(F.xxhash64("d1"), F.lit(EVERY)) == 0).select("shard", "row", "text").mapInArrow(run, "head binary")
    heads = sorted(bytes(r["head"]) for r in some.distinct().orderBy(F.xxhash64("head")).limit(min(SPLIT_SAMPLE, 32 * buckets)).collect())
    return sorted({heads[len(heads) * k // buckets] for k in range(1, buckets)}) if heads else []


def sorted_runs(laid: DataFrame, first: str, grams: str, cuts: list[bytes]) -> DataFrame:
    """Rows with a run (bucket, run, packed) and rows with places (run, number, shard, at), for the anchors grams (shipped)."""
    names = ["bucket", "run", "packed", "number", "shard", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Notes(first), Notes(grams)
        seen: dict[tuple[bytes, bytes], tuple[int, int, list]] = {}
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal weight
            mine = uuid.uuid4().int >> 65
            dealt = defaultdict(list)
            for number, ((suffix, left), (least, most, places)) in enumerate(seen.items()):
                dealt[bisect_right(cuts, suffix[:GRAM])].append((suffix, left, number, min(2, len(places)), least, most))
            for bucket, entries in dealt.items():
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([mine], pa.int64()), pa.array([Run(entries).pack()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
            number = np.repeat(np.arange(len(seen)), [len(v[2]) for v in seen.values()])
            at = np.array([p for v in seen.values() for p in v[2]], np.int64).reshape(-1, 2)
            n = len(number)
            if n:
                yield pa.record_batch([pa.nulls(n, pa.int32()), pa.array(np.full(n, mine)), pa.nulls(n, pa.binary()), pa.array(number), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], names)
            seen.clear()
            weight = 0

        for shard, piece in pieces(batches):
            if not len(some := known.longs(shard)):
                continue
            for row, text, place, since, until in recurring_rows(piece, own.longs(shard), some):
                for p, a, b in zip(place, since, until):
                    name = (text[p : p + LENGTH], text[max(0, p - _REACH) : p])
                    entry = seen.get(name)
                    if entry is None:
                        entry = seen[name] = (p - b, p - a, [])
                        weight += len(name[0]) + len(name[1]) + 300
                    entry[2].append((shard, row << ROW_BITS | p))
                    weight += 64
                if weight > HELD:
                    yield from flush()
        yield from flush()

    return laid.select("shard", "row", "text").mapInArrow(run, "bucket int, run long, packed binary, number long, shard long, at long")


def merged_spans(laid: DataFrame, first: str, grams: str, buckets: int) -> str:
    """Shipped: (row, since, until) of the repeated strings at the anchors grams, found by merging sorted runs."""
    cuts = splitters(laid, first, grams, buckets)
    runs = park(sorted_runs(laid, first, grams, cuts), "runs", compression="zstd")
    sweep(laid.sparkSession)

    def merged(table: pa.Table) -> pa.Table:
        ids = table.column("run").to_pylist()
        found = list(repeated([Run.unpack(x) for x in table.column("packed").to_pylist()]))
        columns = list(zip(*found)) or [()] * 4
        return pa.table({"run": pa.array([ids[r] for r in columns[0]], pa.int64()), "number": pa.array(columns[1], pa.int64()), "since": pa.array(columns[2], pa.int64()), "until": pa.array(columns[3], pa.int64())})

    found = runs.where("packed IS NOT NULL").select("bucket", "run", "packed").groupBy("bucket").applyInArrow(merged, "run long, number long, since long, until long")
    spans = runs.where("packed IS NULL").select("run", "number", "shard", "at").join(found, ["run", "number"])
    place = F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    item = F.struct(F.shiftright("at", ROW_BITS).alias("row"), (place + F.col("since")).alias("since"), (place + F.col("until")).alias("until"))
    out = ship(spans.select("shard", item.alias("item")), "spans")
    discard(runs)
    return out


def strings(piece: pa.RecordBatch, first: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, and two hashes) of every string whose anchor is one of wanted."""
    out = []
    for row, text, _, since, until in recurring_rows(piece, first, wanted):
        flat = np.frombuffer(text, np.uint8)
        start = np.concatenate([np.arange(a, b + 1) for a, b in zip(since, until)])
        one = ranges(prefix(flat.astype(np.uint64) + np.uint64(1), BASES[1]), start, start + LENGTH, BASES[1])
        two = ranges(prefix(mix(flat.astype(np.uint64) + np.uint64(7)), BASES[2]), start, start + LENGTH, BASES[2])
        out.append((np.full(len(start), row), start, one.view(np.int64), two.view(np.int64)))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 4


def counted_strings(laid: DataFrame, first: str, grams: str) -> str:
    """Shipped: the hashes (one, two) of the strings at the anchors grams that are found twice, for each shard that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Notes(first), Notes(grams)
        for shard, piece in pieces(batches):
            if len(some := known.longs(shard)):
                _, _, one, two = strings(piece, own.longs(shard), some)
                pair, n = np.unique(np.stack([one, two]), axis=1, return_counts=True)
                yield pa.record_batch([pa.array(pair[0].copy()), pa.array(pair[1].copy()), pa.array(np.full(len(n), shard)), pa.array(n)], ["one", "two", "shard", "n"])

    seen = laid.select("shard", "row", "text").mapInArrow(run, "one long, two long, shard long, n long")
    twice = seen.groupBy("one", "two").agg(F.sum("n").alias("n"), F.collect_set("shard").alias("shards")).where("n > 1")
    return ship(twice.select(F.explode("shards").alias("shard"), F.struct("one", "two").alias("item")), "strings")


def member(one: np.ndarray, two: np.ndarray, of: pa.Array) -> np.ndarray:
    """Which pairs are among the structs (one, two)."""
    pair = np.stack([np.concatenate([of.field("one").to_numpy(), one]), np.concatenate([of.field("two").to_numpy(), two])])
    _, name = np.unique(pair, axis=1, return_inverse=True)
    return np.isin(name[len(of) :], name[: len(of)])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: binary) of docs (doc_id, text)."""
    spark = docs.sparkSession
    laid = lay_out(docs)
    first = firsts(laid)
    again = recurring(laid, first, lambda flat, offsets: anchors(flat, offsets)[4].view(np.uint64), hot)
    sweep(spark)
    pairs = {r["hot"]: r["n"] for r in again.groupBy("hot").agg(F.count("*").alias("n")).collect()}
    grams = ship(again.where("NOT hot").select("shard", "item"), "grams")
    crowded = ship(again.where("hot").select("shard", "item"), "crowded") if pairs.get(True) else None
    discard(again)
    spans = merged_spans(laid, first, grams, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.get(False, 0) // PER_BUCKET))
    remove_folder(spark, grams)
    sweep(spark)
    twice = counted_strings(laid, first, crowded) if crowded else None

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = Notes(first), Notes(spans)
        known, sure = (Notes(crowded), Notes(twice)) if crowded else (None, None)
        for shard, piece in pieces(batches):
            rows, first_ = piece.column("row").to_numpy(), own.longs(shard)
            flat, offsets = texts(piece.column("text"))
            raw, size = flat.tobytes(), np.diff(offsets)
            step = np.zeros(len(flat) + 1, np.int32)

            def cover(row: np.ndarray, since: np.ndarray, until: np.ndarray) -> None:
                place = np.searchsorted(rows, row)
                here = np.append(rows, -1)[place] == row  # a batch's end may have cut the shard
                np.add.at(step, offsets[place[here]] + since[here], 1)
                np.add.at(step, offsets[place[here]] + until[here], -1)

            if (found := mine.of(shard)) is not None:
                cover(*(found.field(c).to_numpy() for c in ("row", "since", "until")))
            if crowded and (found := sure.of(shard)) is not None:
                row, start, one, two = strings(piece, first_, known.longs(shard))
                keep = member(one, two, found)
                cover(row[keep], start[keep], start[keep] + LENGTH)
            whole = ~np.isin(rows, first_[first_ % 2 == 0] >> 1) & (size >= LENGTH)
            gone = (np.cumsum(step[:-1]) > 0) | np.repeat(whole, size)
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            before[offsets[:-1][size > 0]] = False
            removed, heads = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, gone & ~before))
            kept = [raw[a:b] if not n else b"" if n == b - a else flat[a:b][~gone[a:b]].tobytes() for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), np.diff(removed).tolist())]
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(size), pa.array(np.diff(removed)), pa.array(np.diff(heads)), pa.array([sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return laid.select("doc_id", "shard", "row", "text").mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
