"""Periodic runs: word-id arrays are compared with themselves at every shift up to n / MIN_EXP.

Where words i and i + p are equal for L places in a row, L + p words have period p; a stretch that no neighbour extends
and that is long enough (LEAST words, MIN_EXP periods) is a run. A stretch of that many periods is found again at the
multiples of its smallest period and at no other shift (Fine and Wilf), so the smallest shift of equal stretches is the
period. A shift is first compared at every step-th place, step being a quarter of the shortest stretch that counts:
each such stretch makes three such places in a row equal, whatever its start; around them all places are compared and
the lengths of the true stretches taken. So a shift costs n / p compares, and n where the text does repeat.

Texts of up to LONG bytes are scanned whole, many at a time, by one task each batch: their word ids are laid end to end,
longest text first, so that a shift works on a prefix. Longer texts are dealt over tasks by ranges of LAGS shifts, and
their runs are merged by the smallest period before the text is collapsed. The result is the same either way.

Cases: null and empty texts have no words and no run; equal rows give equal rows; rows without a doc_id are not damaged
(damage()); an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, blocks, joined, park, texts, word_bounds

MIN_EXP = 3
LEAST = 24
#: Bytes of a text beyond which its shifts are dealt over tasks.
LONG = 1 << 19
#: Shifts of one task's range of a long text.
LAGS = 1 << 14

RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, n_dropped long, runs_sha256 string, collapsed_sha256 string"


def damage(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten (by the CRC-32 of its id), the original word that stands at each place after an echo was planted; None: unchanged."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def ids_of(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    keep = np.zeros(len(flat) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    body = flat[np.cumsum(keep[:-1], dtype=np.int8) > 0]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def scan(ids: np.ndarray, offsets: np.ndarray, low: int = 1, high: int | None = None, least: int = LEAST, min_exp: int = MIN_EXP) -> np.ndarray:
    """(row, start, length, period) of all runs of all rows, in that order, from shifts low to high - 1 (all, if high is None)."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    # no two rows share an id, so no stretch crosses from one to the next
    flat = np.concatenate([ids[offsets[r] : offsets[r + 1]] + (k << 40) for k, r in enumerate(order)]) if len(order) else ids
    most = sizes // min_exp
    found = []
    last = min(int(most[0]) if len(most) else 0, high - 1 if high else 1 << 62)
    for p in range(low, last + 1):
        rows = int(np.searchsorted(-most, -p, "right"))
        n = int(ends[rows - 1])
        need = max(least - p, (min_exp - 1) * p)
        step = max(1, need // 4)
        equal = flat[0 : n - p : step] == flat[p:n:step]
        seen = int(need // step) - 1
        hit = equal
        for k in range(1, seen):  # seen of them in a row
            hit = hit[:-1] & equal[k:]
        if not hit.any():
            continue
        a, b = stretches(hit)
        a, b = np.maximum(a * step - step + 1, 0), np.minimum((b + seen - 2) * step + step, n - p)
        for x, y in zip(a.tolist(), b.tolist()):
            s, e = stretches(flat[x:y] == flat[x + p : y + p])
            good = e - s >= need
            for u, v in zip((s[good] + x).tolist(), (e[good] + x).tolist()):
                found.append((u, v - u + p, p))
    if not found:
        return np.zeros((0, 4), np.int64)
    out = np.array(found, np.int64)
    row = np.searchsorted(ends, out[:, 0], "right")
    out = np.column_stack([order[row], out[:, 0] - (ends - sizes)[row], out[:, 1], out[:, 2]])
    return smallest(out)


def smallest(runs: np.ndarray) -> np.ndarray:
    """Of equal (row, start, length) the smallest period; by row, start, period."""
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run (start, length, period) covers after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def best(runs: np.ndarray) -> tuple[int, int, int]:
    """The run of greatest length / period (exactly), the first of equals; runs are by start, then period."""
    top = None
    for start, length, period in runs.tolist():
        if top is None or length * top[2] > top[1] * period:
            top = (start, length, period)
    return top


def report(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray | None, runs: np.ndarray) -> tuple:
    """One text's RESULT."""
    n = len(starts)
    if n:  # of the block's bytes, this text's own
        flat, starts, ends = flat[starts[0] : ends[-1]], starts - starts[0], ends - starts[0]
    stay = np.flatnonzero(kept(n, runs))
    order = stay if at is None else at[stay]
    if at is None or (np.diff(order) > 0).all():
        text = joined(flat, starts[order], ends[order])
    else:
        data = flat.tobytes()
        text = b" ".join(data[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist()))
    listing = "".join(f"{s},{m},{p}\n" for s, m, p in runs.tolist())
    start, length, period = best(runs) or (None, None, None)
    milli = 1000 * length // period if period else None
    return n, len(runs), start, length, period, milli, n - len(stay), hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


#: (doc_id, n) -> places, as damage().
Damage = Callable[[object, int], "np.ndarray | None"]


def _laid(batch: pa.RecordBatch, echo: Damage | None) -> Iterator[tuple]:
    """Blocks of texts: (first row, bytes, starts, ends, word offsets, ids after damage, damage by row)."""
    names = batch.column("doc_id").to_pylist()
    flat, offsets = texts(batch.column("text"))
    for a, b in blocks(offsets):
        part = flat[offsets[a] : offsets[b]]
        starts, ends, first = word_bounds(part, offsets[a : b + 1] - offsets[a])
        ids = ids_of(part, starts, ends)
        planted = {}
        for r in range(b - a) if echo else ():
            at = echo(names[a + r], int(first[r + 1] - first[r]))
            if at is not None:
                planted[r] = at
                ids[first[r] : first[r + 1]] = ids[first[r] : first[r + 1]][at]
        yield a, b, part, starts, ends, first, ids, planted


def _table(rows: list[tuple], schema: pa.Schema, given: list[pa.Array]) -> pa.RecordBatch:
    return pa.record_batch([*given, *[pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [()] * len(schema), schema)]], [*[f"g{k}" for k in range(len(given))], *schema.names])


_OUT = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (x.split() for x in RESULT.split(", "))])


def repeats(docs: DataFrame, echo: Damage | None = None, least: int = LEAST, min_exp: int = MIN_EXP, long: int = LONG, lags: int = LAGS) -> DataFrame:
    """doc_id and RESULT for every row of docs, after echo(doc_id, words) has been planted, if given."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def whole(batches):
        for batch in batches:
            for a, b, part, starts, ends, first, ids, planted in _laid(batch, echo):
                runs = scan(ids, first, least=least, min_exp=min_exp)
                cut = np.searchsorted(runs[:, 0], np.arange(b - a + 1))
                rows = [report(part, starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], planted.get(r), runs[cut[r] : cut[r + 1], 1:]) for r in range(b - a)]
                yield _table(rows, _OUT, [batch.column("doc_id")[a:b]])

    short = docs.where(size <= long).mapInArrow(whole, f"doc_id {kind}, {RESULT}")
    big = park(docs.where(size > long), "long-texts")
    if big.isEmpty():
        return short

    def ranges(batches):
        for batch in batches:
            low = batch.column("low").to_numpy()
            for r in range(batch.num_rows):
                for _, _, _, _, _, first, ids, _ in _laid(batch.slice(r, 1), echo):
                    runs = scan(ids, first, int(low[r]), int(low[r]) + lags, least, min_exp)
                    given = [pa.array([batch.column(c)[r].as_py()] * len(runs), batch.schema.field(c).type) for c in ("doc_id", "key")]
                    yield pa.record_batch([*given, *[pa.array(runs[:, k]) for k in (1, 2, 3)]], ["doc_id", "key", "start", "length", "period"])

    big = big.withColumn("key", F.md5("text"))
    last = F.regexp_count("text", F.lit(WORD)).cast("long") / min_exp
    dealt = big.distinct().select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(last.cast("long"), F.lit(1)), F.lit(lags).cast("long"))).alias("low"))
    n = max(2, docs.sparkSession.sparkContext.defaultParallelism)
    runs = dealt.repartition(n, "key", "low").mapInArrow(ranges, f"doc_id {kind}, key string, start long, length long, period long")
    runs = runs.groupBy("doc_id", "key", "start", "length").agg(F.min("period").alias("period"))
    # a text of n words has fewer than n runs, so a row's list is no longer than its text
    runs = runs.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    ready = big.join(runs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "runs")

    def finish(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                listed = np.array([(x["start"], x["length"], x["period"]) for x in batch.column("runs")[r].as_py() or ()], np.int64).reshape(-1, 3)
                for _, _, part, starts, ends, _, _, planted in _laid(batch.slice(r, 1), echo):
                    yield _table([report(part, starts, ends, planted.get(0), listed)], _OUT, [batch.column("doc_id")[r : r + 1]])

    return short.unionByName(ready.mapInArrow(finish, f"doc_id {kind}, {RESULT}"))
