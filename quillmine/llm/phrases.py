"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words. Every window has a phrase, the PHRASE words of least hash in it, so equal windows
have equal phrases. (1) Texts are laid out in shards; of equal texts only the first is looked at, as every window of
its copies starts earlier there. (2) Phrases are counted by hash; where a hash recurs, the shard's texts give the
passages themselves, and a passage whose text is found twice is confirmed. (3) Each shard has the confirmed passages
of its documents, compiled into Aho-Corasick automata of at most PASSAGES each, and all documents of the shard are streamed through them.
Their hits, and nothing else, give the places. (4) Windows whose phrase stands at such a place are candidates; the
earliest place of each (by 128-bit hash) is found by a pre-aggregated minimum. (5) The texts are read once more:
candidates that are not earliest are removed.
A shard's automata hold only what its own documents repeat, so work grows with the input; no step exchanges a text.

Cases: null and empty texts have no words; texts of fewer than WINDOW words lose none; rows with a null doc_id come
after all others, in an order of their own (by text), and keep a null doc_id; of rows that are equal, or have equal
texts and no doc_id, one comes first and the others lose every window; rows that share a doc_id with different texts
count as one document; an empty table gives an empty result. doc_id must be an integer. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined, remove_folder, sweep, texts, word_bounds
from .hashes import BASES, minimizers, mix, prefix, ranges, sliding
from .shards import Notes, chosen, firsts, lay_out, pieces, recurring, ship

WINDOW = 20
PHRASE = 8
#: Passages in one automaton (about 50 nodes each).
PASSAGES = 40_000
#: An item about words of a row: row << ROW_BITS | word << 5 | windows that start from there on.
ROW_BITS = 45

class Block:
    """Words of a block of texts, with phrase and window hashes at every word."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat = flat
        self.starts, self.ends, self.first = word_bounds(flat, offsets)

    @cached_property
    def words(self) -> np.ndarray:
        return ranges(prefix(self.flat.astype(np.uint64) + np.uint64(1), BASES[0]), self.starts, self.ends, BASES[0])

    @cached_property
    def phrase(self) -> np.ndarray:
        return sliding(prefix(self.words, BASES[1]), PHRASE, BASES[1])

    def line(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words (those to keep) with one space around each, and where each starts and ends."""
        starts, ends = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        stop = np.cumsum(ends - starts + 1)
        return b" " + joined(self.flat, starts, ends) + b" ", stop - (ends - starts), stop

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the windows that start at the words at."""
        one = ranges(prefix(self.words, BASES[2]), at, at + WINDOW, BASES[2])
        two = ranges(prefix(mix(self.words + np.uint64(7)), BASES[0]), at, at + WINDOW, BASES[0])
        return one.view(np.int64), two.view(np.int64)

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, word of its phrase) of every window."""
        least = minimizers(self.phrase, WINDOW - PHRASE + 1)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + WINDOW <= self.first[row + 1])
        return row[start], start, least[start]

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of every window's phrase, each once."""
        row, _, place = self.anchored()
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        return row[new], place[new]


def automata(passages: list[bytes]) -> Iterator[ahocorasick.Automaton]:
    """Passages (words with a space around each), compiled PASSAGES at a time."""
    for at in range(0, len(passages), PASSAGES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for passage in passages[at : at + PASSAGES]:
            automaton.add_word(passage.decode("latin-1"))
        automaton.make_automaton()
        yield automaton


def occurrences(block: Block, passages: list[bytes]) -> np.ndarray:
    """Which words of the block start a passage."""
    line, _, stop = block.line()
    stream, located = line.decode("latin-1"), np.zeros(len(block.starts) + 1, bool)
    for automaton in automata(passages):
        last = np.fromiter((end for end, _ in automaton.iter(stream)), np.int64)
        located[np.searchsorted(stop, last) - PHRASE + 1] = True
    return located


def confirmed(laid: DataFrame, first: str) -> str:
    """Shipped: the passages of each shard that are found twice, in whatever shards."""
    phrase = lambda flat, offsets: (lambda b: b.phrase[b.chosen()[1]])(Block(flat, offsets))
    again = recurring(laid, first, phrase)
    sweep(laid.sparkSession)
    wanted = ship(again.select("shard", "item"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = Notes(first), Notes(wanted)
        for shard, piece in pieces(batches):
            if not len(some := hashes.longs(shard)):
                continue
            block = Block(*texts(chosen(piece, own.longs(shard)).column("text")))
            place = block.chosen()[1]
            place = place[np.isin(block.phrase[place].view(np.int64), some)]
            line, begin, stop = block.line()
            found = Counter(line[i - 1 : j + 1] for i, j in zip(begin[place].tolist(), stop[place + PHRASE - 1].tolist()))
            yield pa.record_batch([pa.array([shard] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["shard", "item", "n"])

    passages = laid.select("shard", "row", "text").mapInArrow(run, "shard long, item binary, n long")
    twice = passages.groupBy("item").agg(F.sum("n").alias("n"), F.collect_set("shard").alias("shards")).where("n > 1")
    out = ship(twice.select(F.explode("shards").alias("shard"), "item"), "passages")
    discard(again)
    remove_folder(laid.sparkSession, wanted)
    return out


def located(laid: DataFrame, first: str, passages: str) -> str:
    """Shipped: the runs of candidate windows of each shard, from the automata's hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Notes(first), Notes(passages)
        for shard, piece in pieces(batches):
            if (some := known.of(shard)) is None:
                continue
            part = chosen(piece, own.longs(shard))
            block = Block(*texts(part.column("text")))
            hits = occurrences(block, some.to_pylist())
            row, start, place = block.anchored()
            at = np.flatnonzero(hits[place])
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(start[at]) > 1) | (np.diff(place[at]) != 0) | (np.diff(row[at]) != 0)
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(at)))
            row, start = row[at[head]], start[at[head]]
            item = (part.column("row").to_numpy()[row].astype(np.int64) << ROW_BITS) | (start - block.first[row]) << 5 | n
            yield pa.record_batch([pa.array(np.full(len(item), shard)), pa.array(item)], ["shard", "item"])

    return ship(laid.select("shard", "row", "text").mapInArrow(run, "shard long, item long"), "runs")


def spread(items: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in rows, start) of every candidate window of runs; rows (ascending) are those of a piece, runs of others are left out."""
    place = np.searchsorted(rows, items >> ROW_BITS)
    items, place = (x[np.append(rows, -1)[place] == items >> ROW_BITS] for x in (items, place))
    n = items & 31
    start = (items >> 5 & (1 << ROW_BITS - 5) - 1).repeat(n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return place.repeat(n), start


def earliest(laid: DataFrame, first: str, runs: str) -> str:
    """Shipped: (row, starts) of the windows that start nowhere earlier, among the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = Notes(first), Notes(runs)
        for shard, piece in pieces(batches):
            if not len(items := mine.longs(shard)):
                continue
            part = chosen(piece, own.longs(shard))
            block = Block(*texts(part.column("text")))
            row, start = spread(items, part.column("row").to_numpy())
            key = part.column("key").to_numpy()[row]
            one, two = block.windows(block.first[row] + start)
            # of equal windows of a piece the first is enough
            order = np.lexsort((start, key))
            _, new = np.unique((mix(one.view(np.uint64) + np.uint64(1)) ^ two.view(np.uint64))[order], return_index=True)
            kept = order[new]
            yield pa.record_batch([pa.array(x[kept]) for x in (one, two, key, start.astype(np.int32))], ["one", "two", "key", "start"])

    places = laid.select("shard", "row", "key", "text").mapInArrow(run, "one long, two long, key long, start int")
    # a document has one start for each window, so the start of the least key is the earliest; plain columns keep the aggregation hashed
    best = places.groupBy("one", "two").agg(F.min("key").alias("first"), F.min_by("start", "key").alias("start"))
    best = best.groupBy(F.col("first").alias("key")).agg(F.collect_set("start").alias("starts"))
    where = laid.groupBy("d1", "d2").agg(F.min(F.struct("key", "shard", "row")).alias("least")).select("least.*")
    return ship(where.join(best, "key").select("shard", F.struct("row", "starts").alias("item")), "earliest")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of docs (doc_id, text); kept is the text that is left."""
    laid = lay_out(docs)
    first = firsts(laid)
    passages = confirmed(laid, first)
    sweep(docs.sparkSession)
    runs = located(laid, first, passages)
    remove_folder(docs.sparkSession, passages)
    sweep(docs.sparkSession)
    winners = earliest(laid, first, runs)
    sweep(docs.sparkSession)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine, best = Notes(first), Notes(runs), Notes(winners)
        for shard, piece in pieces(batches):
            rows = piece.column("row").to_numpy()
            block = Block(*texts(piece.column("text")))
            step = np.zeros(len(block.starts) + WINDOW + 1, np.int32)
            if len(items := mine.longs(shard)):
                row, start = spread(items, rows)
                at = block.first[row] + start
                if (won := best.of(shard)) is not None:
                    won_row = np.repeat(won.field("row").to_numpy(), won.field("starts").value_lengths().to_numpy())
                    place = np.searchsorted(rows, won_row)
                    here = np.append(rows, -1)[place] == won_row
                    at = np.setdiff1d(at, block.first[place[here]] + won.field("starts").flatten().to_numpy()[here])
                step[at] += 1
                step[at + WINDOW] -= 1
            keep = np.cumsum(step)[: len(block.starts)] == 0
            size = np.diff(block.first)
            copy = ~np.isin(rows, own.longs(shard) >> 1) & (size >= WINDOW)
            keep &= ~np.repeat(copy, size)
            line, begin, stop = block.line(keep)
            left = np.concatenate([[0], np.cumsum(keep)])[block.first]
            kept = [line[begin[i] : stop[j - 1]] if j > i else b"" for i, j in zip(left[:-1].tolist(), left[1:].tolist())]
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(size), pa.array(size - np.diff(left)), pa.array([sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return laid.select("doc_id", "shard", "row", "text").mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
