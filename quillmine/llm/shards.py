"""Texts laid out once in shards, and side tables that reach the shards as files.

lay_out() writes the texts as it meets them, without an exchange: a shard is a run of rows of about SHARD_BYTES of
text in one task (a longer text is a shard of its own), and a part is what one task wrote. ship() turns what a later
step found for the shards into one row for each shard, sorted, in one folder for each part. Tasks that read the texts
read the parts they need along with them (Notes), one shard at a time. So no step exchanges a text, and no shard
holds more than its own texts' share of a side table.

Equal texts need one look: firsts() names for each text the row that stands first (by key, then by place).
recurring() tells which hashes occur twice among all shards. It sees a hash once for each shard, so a hash found in
every document costs one row for each shard, and it streams over sorted rows without holding a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import park, row_key, scratch, shared_file, texts

SHARD_BYTES = 2 << 20
#: Rows of a shard at most, and bits that number the shards of a part.
ROWS, SHARD_BITS = 1 << 16, 32


def lay_out(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) written with key, shard, row (in the shard) and a 128-bit digest (d1, d2) of the text."""
    source = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, row = TaskContext.get().partitionId() << SHARD_BITS, 0, 0
        for batch in batches:
            flat, offsets = texts(batch.column("text"))
            raw, edges = flat.tobytes(), offsets.tolist()
            places, digests = [], []
            for a, b in zip(edges, edges[1:]):
                if row and (held + b - a > SHARD_BYTES or row == ROWS):
                    shard, held, row = shard + 1, 0, 0
                places.append((shard, row))
                digests.append(blake2b(raw[a:b], digest_size=16).digest())
                held, row = held + b - a, row + 1
            place = np.array(places, np.int64).reshape(-1, 2)
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [place[:, 0].copy(), place[:, 1].astype(np.int32), digest[:, 0].copy(), digest[:, 1].copy()]
            yield pa.record_batch([*batch.columns, *map(pa.array, columns)], [*batch.schema.names, "shard", "row", "d1", "d2"])

    schema = source.select("*").schema.add("shard", "long").add("row", "integer").add("d1", "long").add("d2", "long")
    return park(source.mapInArrow(run, schema), "texts", compression="zstd")


def ship(items: DataFrame, name: str) -> str:
    """The folder with items (shard, item) as (shard, items) by part."""
    path = scratch(items.sparkSession, name)
    rows = items.withColumn("part", F.shiftright("shard", SHARD_BITS)).repartition("part")
    rows = rows.groupBy("part", "shard").agg(F.collect_list("item").alias("items"))  # dealt by part already
    rows.sortWithinPartitions("part", "shard").write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


class Notes:
    """A task's reader of a shipped folder. Shards are asked for mostly in ascending order; going back opens the part anew."""

    def __init__(self, uri: str):
        self.uri, self.part, self.rows, self.now = uri, None, iter(()), (-1, None)

    def _open(self, part: int) -> Iterator[tuple[int, pa.Array]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = shared_file(self.uri)

        def read(file: str) -> Iterator[tuple[int, pa.Array]]:
            with system.open_input_file(file) as data:
                for batch in pq.ParquetFile(data).iter_batches(16, columns=["shard", "items"]):
                    for k, shard in enumerate(batch.column("shard").to_pylist()):
                        yield shard, batch.column("items")[k].values

        found = system.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True))
        return heapq.merge(*(read(f.path) for f in found if f.base_name.endswith(".parquet")), key=lambda x: x[0])

    def of(self, shard: int) -> pa.Array | None:
        """The items of a shard, or None."""
        if self.part != shard >> SHARD_BITS or self.now[0] > shard:
            self.part, self.now = shard >> SHARD_BITS, (-1, None)
            self.rows = self._open(self.part)
        while self.now[0] < shard:
            self.now = next(self.rows, (1 << 63, None))
        return self.now[1] if self.now[0] == shard else None

    def longs(self, shard: int) -> np.ndarray:
        items = self.of(shard)
        return items.to_numpy(zero_copy_only=False) if items is not None else np.zeros(0, np.int64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one shard; a batch's end may cut a shard in two."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b > a:
                yield int(shard[a]), batch.slice(a, b - a)


def firsts(laid: DataFrame) -> str:
    """Shipped: the rows (2 * row, and 1 if the text has copies) that are first of their text."""
    least = laid.groupBy("d1", "d2").agg(F.min(F.struct("key", "shard", "row")).alias("least"), F.count("*").alias("n"))
    return ship(least.select("least.shard", (F.col("least.row") * 2 + (F.col("n") > 1).cast("int")).alias("item")), "firsts")


def chosen(piece: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """The rows of a piece that are first of their text."""
    return piece.filter(pa.array(np.isin(piece.column("row").to_numpy(), first >> 1)))


def doubles(counts: DataFrame, hot: int) -> DataFrame:
    """(shard, item, hot) for the rows of counts (hash, shard, n) whose hash has n of two or more in all."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held, known, total = empty, None, 0  # the last hash's rows, and a hash found hot whose rows are out already

        def out(hash_, shard, n):
            edge = np.concatenate([[0], np.flatnonzero(np.diff(hash_)) + 1])
            sums = np.add.reduceat(n, edge)
            sums[0] += total if hash_[0] == known else 0
            every = np.repeat(sums, np.diff(np.append(edge, len(n))))
            keep = every > 1
            return pa.record_batch([pa.array(shard[keep]), pa.array(hash_[keep]), pa.array(every[keep] > hot)], ["shard", "item", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([a, batch.column(c).to_numpy()]) for a, c in zip(held, ("hash", "shard", "n"))]
            last = np.searchsorted(now[0], now[0][-1])
            if (many := int(now[2][last:].sum()) + (total if now[0][-1] == known else 0)) > hot:
                yield out(*now)
                held, known, total = empty, now[0][-1], many
                continue
            if last:
                yield out(*(x[:last] for x in now))
            held = tuple(x[last:] for x in now)
        if len(held[0]):
            yield out(*held)

    return counts.repartition("hash").sortWithinPartitions("hash").mapInArrow(select, "shard long, item long, hot boolean")


def recurring(laid: DataFrame, first: str, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], hot: int = 1 << 62) -> DataFrame:
    """Written: (shard, item, hot) of the hashes (of first texts, flat and offsets) that occur twice or more; hot if more than hot times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Notes(first)
        for shard, piece in pieces(batches):
            found, n = np.unique(hashes(*texts(chosen(piece, own.longs(shard)).column("text"))), return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.full(len(found), shard)), pa.array(n.astype(np.int32))], ["hash", "shard", "n"])

    counts = laid.select("shard", "row", "text").mapInArrow(count, "hash long, shard long, n int")
    return park(doubles(counts, hot), "recurring", compression="zstd")
