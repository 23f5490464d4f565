"""Names in lines: every line with the names that it contains, by each name's rarest gram.

A line that contains a name contains all its q-grams, and so its rarest. Grams of the names are counted in the lines
first; a name is then looked for only where its gram of fewest places stands, at the one start that this allows, and the
text decides. Names shorter than q are a gram themselves.

Names of at most SMALL bytes, measured, go to every task: there grams are numbers of q bytes, taken from all lines of a
batch at once in windows of WINDOW bytes, counted in a first pass and looked up in a second. UTF-8 lets no name begin
inside a character, so bytes give the same places as characters. No text is exchanged, and a row is made for each name
found only. More names than that meet the lines by an equi-join on the gram: lines are cut into pieces of WIDTH
characters, or of the longest name's; a piece with its neighbours holds every name that it has a gram of, so a long line
is neither one row nor searched from its start for every place; grams with more than HOT names have these dealt over parts.

Cases: null and empty names and null lines contain nothing; equal names are one; letters count as they are; places count
code points from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

Q, HOT, WIDTH = 4, 2_000, 64
#: Bytes of names up to which they are sent to every task, measured; beyond that places and pieces are exchanged.
SMALL = 4 << 20
#: Bytes of lines whose grams are numbers at the same time, and candidates that are compared at the same time.
WINDOW = 1 << 20


def _grams(rows: DataFrame, text: Column, size: int, at: str) -> DataFrame:
    """rows with every gram of text and its place, counted from 0; rows whose text is shorter have none."""
    some = rows.withColumn("whole", text).where(F.length("whole") >= size)
    # places are exploded, not grams, so that generated code takes the grams
    each = some.select(*rows.columns, "whole", F.explode(F.sequence(F.lit(0), F.length("whole") - size)).alias(at))
    return each.select(*rows.columns, at, F.substr("whole", F.col(at) + 1, F.lit(size)).alias("gram"))


def _pieces(lines: DataFrame, width: int) -> DataFrame:
    """(id, piece, before, text, after) of lines (id, line), cut in one pass."""
    cuts = lines.select("id", F.regexp_extract_all("line", F.lit(f"(?s).{{1,{width}}}"), F.lit(0)).alias("cuts"))
    near = lambda i: F.coalesce(F.get("cuts", i), F.lit(""))
    each = F.transform("cuts", lambda text, i: F.struct(near(i - 1).alias("before"), text.alias("text"), near(i + 1).alias("after")))
    return cuts.select("id", F.posexplode(each).alias("piece", "cut")).select("id", "piece", "cut.*")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the n+1 offsets of its rows in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def _windows(flat: np.ndarray, at: np.ndarray, k: int, wanted: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, rows, numbers in wanted) of the k-byte grams of flat that are in wanted (sorted) and in one row."""
    mask = (1 << 22) - 1
    mix = lambda codes: (codes ^ codes >> 13) & mask
    seen = np.zeros(mask + 1, bool)
    seen[mix(wanted)] = True
    for low in range(0, len(flat) - k + 1, window):
        part = flat[low : low + window + k - 1].astype(np.int64)
        codes = part[: len(part) - k + 1]
        for j in range(1, k):
            codes = codes << 8 | part[j : len(part) - k + 1 + j]
        maybe = np.flatnonzero(seen[mix(codes)])
        codes = codes[maybe]
        number = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
        good = wanted[number] == codes
        places, number = maybe[good] + low, number[good]
        rows = np.searchsorted(at, places, "right") - 1
        inside = places + k <= at[rows + 1]
        yield places[inside], rows[inside], number[inside]


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows whose counts add up to about most."""
    total, first = np.cumsum(counts), 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
        yield slice(first, last)
        first = last


def _by_numbers(lines: DataFrame, names: list[str], q: int) -> DataFrame:
    """contained() of names of bounded size: count their grams in the lines, then look for each name at its rarest."""
    spark, window = lines.sparkSession, WINDOW
    blob, ends = _flat(pa.array(names, pa.string()))
    sizes = np.minimum(np.diff(ends), q)
    own = {}  # by size: the names' places, rows and gram numbers, and the sorted grams
    for k in map(int, np.unique(sizes)):
        every = _every(blob, ends, k)
        keep = sizes[every[1]] == k
        grams, number = np.unique(every[2][keep], return_inverse=True)
        own[k] = every[0][keep], every[1][keep], number, grams
    shipped = spark.sparkContext.broadcast({k: v[3] for k, v in own.items()})  # at most SMALL grams

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(grams), np.int64) for k, grams in shipped.value.items()}
        for batch in batches:
            flat, at = _flat(batch.column("line"))
            for k, grams in shipped.value.items():
                for _, _, number in _windows(flat, at, k, grams, window):
                    sums[k] += np.bincount(number, minlength=len(grams))
        for k, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], ["size", "gram", "n"])

    counts = lines.select("line").mapInArrow(tally, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # a row for a gram of the names at most
    size, gram, n = (found.column(c).to_numpy() for c in ("size", "gram", "n"))
    keys = {}  # by size: gram values, and for each of them its names and where the gram is in the name
    for k, (places, rows, number, grams) in own.items():
        often = np.zeros(len(grams), np.int64)
        often[gram[size == k]] = n[size == k]
        order = np.lexsort((places, number, often[number], rows))  # of a name's grams the rarest, the first of equals
        order = order[np.append(True, np.diff(rows[order]) > 0)]
        order = order[often[number[order]] > 0]
        order = order[np.argsort(number[order], kind="stable")]
        mine, first = np.unique(number[order], return_index=True)
        if len(mine):
            keys[k] = grams[mine], np.append(first, len(order)), rows[order], places[order] - ends[rows[order]]
    sent = spark.sparkContext.broadcast((names, keys))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys = sent.value
        spelled = pa.array(names, pa.string())
        blob, ends = _flat(spelled)
        for batch in batches:
            flat, at = _flat(batch.column("line"))
            hits = [np.zeros((3, 0), np.int64)]
            for k, (grams, first, owner, inside) in keys.items():
                for places, rows, number in _windows(flat, at, k, grams, window):
                    many = np.diff(first)[number]
                    for part in _slices(many, window):
                        take = np.repeat(first[number[part]] - np.cumsum(many[part]) + many[part], many[part]) + np.arange(many[part].sum())
                        line, name = np.repeat(rows[part], many[part]), owner[take]
                        start = np.repeat(places[part], many[part]) - inside[take]
                        hits.append(_first(_standing(flat, at, blob, ends, np.stack([line, name, start]))))
            line, name, start = _first(np.concatenate(hits, axis=1))
            before = start - at[line]
            if len(flat) and flat.max() > 127:
                heads = np.append(0, np.cumsum((flat & 0xC0) != 0x80))
                before = heads[start] - heads[at[line]]
            yield pa.record_batch([batch.column("id").take(pa.array(line)), spelled.take(pa.array(name)), pa.array(before + 1)], ["id", "name", "at"])

    kind = lines.schema["id"].dataType.simpleString()
    return lines.mapInArrow(look, f"id {kind}, name string, at long")


def _every(flat: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, rows, grams) of all k-byte grams of flat that are in one row."""
    places = np.arange(max(0, len(flat) - k + 1))
    rows = np.searchsorted(at, places, "right") - 1
    places, rows = (x[places + k <= at[rows + 1]] for x in (places, rows))
    codes = np.zeros(len(places), np.int64)
    for j in range(k):
        codes = codes << 8 | flat[places + j]
    return places, rows, codes


def _standing(flat: np.ndarray, at: np.ndarray, blob: np.ndarray, ends: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Of maybe (line, name, start) those whose name stands there: 16 bytes are compared at once, the few left one by one."""
    line, name, start = maybe
    length = ends[name + 1] - ends[name]
    maybe = maybe[:, (start >= at[line]) & (start + length <= at[line + 1])]
    for j in range(16):
        _, name, start = maybe
        long = ends[name + 1] - ends[name] > j
        if not long.any():
            return maybe
        same = ~long
        same[long] = flat[start[long] + j] == blob[ends[name[long]] + j]
        maybe = maybe[:, same]
    _, name, start = maybe
    length = ends[name + 1] - ends[name]
    good = length <= 16
    for i in np.flatnonzero(~good):
        good[i] = flat[start[i] : start[i] + length[i]].tobytes() == blob[ends[name[i]] : ends[name[i] + 1]].tobytes()
    return maybe[:, good]


def _first(hits: np.ndarray) -> np.ndarray:
    """Of (line, name, start) the first start of each line and name."""
    hits = hits[:, np.lexsort(hits[::-1])]
    new = np.append(True, (np.diff(hits[0]) != 0) | (np.diff(hits[1]) != 0))[: hits.shape[1]]
    return hits[:, new]


def contained(lines: DataFrame, names: DataFrame, q: int = Q) -> DataFrame:
    """(id, name, at) of lines (id, line) and all names (name) in them, with the first place; ids of lines are unique."""
    names = cut(names.select("name").where("name <> ''").distinct())
    size = F.least(F.length("name"), F.lit(q))
    lines = lines.select("id", "line").where("line IS NOT NULL")
    found = names.groupBy(size.alias("size")).agg(F.max(F.length("name")).alias("longest"), F.sum(F.octet_length("name") + 64).alias("bytes")).collect()  # q rows at most
    if not found:
        return lines.select("id", F.col("line").alias("name"), F.lit(0).cast("long").alias("at")).limit(0)
    if sum(r["bytes"] for r in found) <= SMALL:
        return _by_numbers(lines, sorted(r["name"] for r in names.collect()), q)
    sizes, width = sorted(r["size"] for r in found), max(WIDTH, *[r["longest"] for r in found])
    pieces = _pieces(lines, width)
    mine = wide = None
    for k in sizes:
        some = _grams(names.where(size == k), F.col("name"), k, "offset")
        mine = some if mine is None else mine.unionByName(some)
        some = _grams(pieces, F.concat("text", F.substring("after", 1, k - 1)), k, "at")
        wide = some if wide is None else wide.unionByName(some)
    mine, places = cut(mine), wide.select("id", "piece", "at", "gram")
    # Spark broadcasts the wanted grams where they are known to be small
    counts = places.join(mine.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # of a name's grams one is kept: the rarest, the first of equals, at its first place
    key = mine.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "offset")).alias("key"))
    keys = cut(key.where("key.n > 0").select("name", "key.gram", "key.offset"))
    first = F.length("before") + F.col("start")
    around, stands = F.concat("before", "text", "after"), lambda text: (first >= 0) & (F.substr(text, first + 1, F.length("name")) == F.col("name"))
    crowds = cut(keys.groupBy("gram").agg(F.count("*").alias("m")).select("gram", F.ceil(F.col("m") / HOT).cast("int").alias("parts")))
    keys = keys.join(crowds.where("parts > 1"), "gram", "left").select("name", "gram", "offset", F.pmod(F.xxhash64("name"), F.coalesce("parts", F.lit(1))).alias("part"))
    dealt = places.join(crowds, "gram").select("id", "piece", "at", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    # from the start of the piece; names that begin before it begin in the piece before
    maybe = dealt.join(keys, ["gram", "part"]).select("id", "piece", "name", (F.col("at") - F.col("offset")).alias("start"))
    hits = maybe.join(pieces, ["id", "piece"]).where(stands(around))
    return hits.groupBy("id", "name").agg(F.min(F.col("piece").cast("long") * width + F.col("start") + 1).alias("at"))
