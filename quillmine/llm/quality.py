"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

A text is its distinct words (ASCII letters in lower case, hashed into 2**BITS buckets, each of weight one by the root
of their number), STATS figures of its structure (standardised on the sample), and its recorded length n_chars as one of
33 classes (powers of two; null or no such column is a class of its own). A score is the logistic function of
w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; all pairs cost as much as one pass over the features, since the pair sum
is half of sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2).

The machine is fitted on the driver, on at most SAMPLE labelled texts of each class (picked by hash, reduced to features
by Spark); scoring covers every whole text and ships only the weights, (2**BITS + STATS + 33) * (RANK + 1) floats.

Cases: null and empty texts have no words and all figures 0, and get a score like any other; equal texts with equal
n_chars get equal scores; labels that are null or name no document, and documents labelled both 0 and 1, are not used;
with labels of one class only the score is that class's share; an empty table gives an empty result; lang, source,
doc_id and further columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashes
from .common import blocks, park, texts, word_bounds

BITS = 16
RANK = 8
#: Labelled texts of each class that the fit uses at most.
SAMPLE = 3000
THRESHOLD = 0.3
#: How far the intercept leans from the classes' shares in the labels (0) to equal shares (1).
LEAN = 0.5
#: Figures of structure, see figures().
STATS = 14
LENGTHS = 33
WIDTH = (1 << BITS) + STATS + LENGTHS
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.02, 1e-3, 11
#: Batches that the fit takes at least: few labels are gone through more often.
STEPS = 600

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 other symbol, 6 white space, 7 beyond ASCII
_KIND[33:127], _KIND[65:91], _KIND[97:123], _KIND[48:58] = 5, 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"-"]] = 4
_KIND[[32, *range(9, 14)]], _KIND[128:] = 6, 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _rows(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over rows from running sums (n+1 of them)."""
    return np.diff(sums[offsets]).astype(np.float64)


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def figures(flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """STATS numbers a row: sizes, shares of kinds of bytes, and how much the words repeat."""
    n_bytes, n_words = np.diff(offsets).astype(np.float64), np.diff(first).astype(np.float64)
    kind = _KIND[flat]
    share = [_rows(_running(kind == k), offsets) / np.maximum(n_bytes, 1) for k in range(1, 8)]
    letters = share[0] + share[1] + share[6]
    lengths = _rows(np.concatenate([[0], np.cumsum(ends - starts)]), first)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][n_words > 0]] = False
    mute = ~np.isin(_KIND[flat[starts]], (1, 2, 3, 7)) if len(starts) else np.zeros(0, bool)
    per_word = np.maximum(n_words, 1)
    return np.column_stack([
        np.log1p(n_bytes), np.log1p(n_words), lengths / per_word, share[0] / np.maximum(letters, 1e-9), *share[2:7],
        _rows(_running(flat == 10), offsets) / per_word, distinct / per_word, _rows(_running(again), first) / per_word,
        _rows(_running(mute), first) / per_word, _rows(_running(flat == 33), offsets) / per_word,
    ])


def features(column: pa.Array, n_chars: np.ndarray):
    """(first row, last, rows, buckets, weights, figures) of blocks of texts: the words' and the length's features, rows from 0, and the figures as they are."""
    flat, offsets = texts(column)
    for a, b in blocks(offsets):
        part, at = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, at)
        words = hashes.ranges(hashes.prefix(_LOWER[part], hashes.BASES[0]), starts, ends, hashes.BASES[0])
        row = np.repeat(np.arange(b - a), np.diff(first))
        order = np.lexsort((words, row))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
        chosen = order[new]
        distinct = np.bincount(row[chosen], minlength=b - a)
        keys = np.unique((row[chosen].astype(np.int64) << BITS) | (words[chosen] >> np.uint64(64 - BITS)).astype(np.int64))
        rows, buckets = keys >> BITS, keys & ((1 << BITS) - 1)
        size = n_chars[a:b]
        length = np.where(size < 0, LENGTHS - 1, np.minimum(np.ceil(np.log2(np.maximum(size, 0) + 1)), LENGTHS - 2)).astype(np.int64)
        weight = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=b - a), 1))
        yield (
            a, b, np.concatenate([rows, np.arange(b - a)]), np.concatenate([buckets, (1 << BITS) + STATS + length]),
            np.concatenate([weight[rows], np.full(b - a, 0.3)]), figures(part, at, starts, ends, first, words, distinct),
        )


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def with_figures(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The features with standardised figures added, in the order of rows."""
        n = len(stats)
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) * 0.5
        rows = np.concatenate([rows, np.repeat(np.arange(n), STATS)])
        columns = np.concatenate([columns, np.tile((1 << BITS) + np.arange(STATS), n)])
        values = np.concatenate([values, scaled.ravel()])
        order = np.argsort(rows, kind="stable")
        return rows[order], columns[order], values[order]

    def margins(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits of n rows, and the RANK sums of each; the features cost one pass."""
        own = self.factors[columns]
        sums = np.stack([np.bincount(rows, values * own[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(rows, values**2 * (own**2).sum(1), n)
        return self.bias + np.bincount(rows, values * self.linear[columns], n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, column: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        out = np.empty(len(column))
        for a, b, rows, columns, values, stats in features(column, n_chars):
            z, _ = self.margins(*self.with_figures(rows, columns, values, stats), b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return out


def constant(share: float) -> Machine:
    odds = float(np.log(share / (1 - share))) if 0 < share < 1 else (700.0 if share else -700.0)
    return Machine(odds, np.zeros(WIDTH), np.zeros((WIDTH, RANK)), np.zeros(STATS), np.ones(STATS))


def train(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, stats: np.ndarray, labels: np.ndarray) -> Machine:
    """Logistic loss, Adam on batches of BATCH rows in an order that SEED fixes; only features of the batch move (lazy)."""
    n, rng = len(labels), np.random.default_rng(SEED)
    epochs = max(EPOCHS, -(-STEPS // -(-n // BATCH)))
    spread = stats.std(0)
    machine = Machine(float(np.log(labels.sum() / (n - labels.sum()))), np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK)), stats.mean(0), np.where(spread > 1e-9, spread, 1.0))
    rows, columns, values = machine.with_figures(rows, columns, values, stats)
    cut = np.searchsorted(rows, np.arange(n + 1))
    first, second = np.zeros((WIDTH, RANK + 1)), np.zeros((WIDTH, RANK + 1))
    step = 0
    for epoch in range(epochs):
        order, rate = rng.permutation(n), RATE * (1 - epoch / epochs)
        for k in range(0, n, BATCH):
            some = order[k : k + BATCH]
            at = np.concatenate([np.arange(cut[r], cut[r + 1]) for r in some])
            own = np.repeat(np.arange(len(some)), cut[some + 1] - cut[some])
            col, x = columns[at], values[at]
            z, sums = machine.margins(own, col, x, len(some))
            error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - labels[some]) / len(some)
            grad_v = (error[own] * x)[:, None] * (sums[own] - machine.factors[col] * x[:, None])
            grad = np.concatenate([grad_v, (error[own] * x)[:, None]], 1)
            used, place = np.unique(col, return_inverse=True)
            total = np.zeros((len(used), RANK + 1))
            np.add.at(total, place, grad)
            step += 1
            now = np.concatenate([machine.factors[used], machine.linear[used, None]], 1)
            total += DECAY * now / len(some)
            first[used] = 0.9 * first[used] + 0.1 * total
            second[used] = 0.999 * second[used] + 0.001 * total**2
            now -= rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
            machine.factors[used], machine.linear[used] = now[:, :RANK], now[:, RANK]
            machine.bias -= rate * float(error.sum())
    return machine


def _sizes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.float64)


def inputs(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, then text and n_chars (-1 where there is none)."""
    known = "n_chars" in docs.columns
    return docs.select(*keep, "text", (F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)) if known else F.lit(-1).cast("long")).alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on labels (doc_id, label 0 or 1) and the texts of docs."""
    labels = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("most"))
    labels = park(labels.where("label = most").select("doc_id", "label"), "quality-labels")
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return constant(float(1 in counts))
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = labels.where("label = 0").orderBy(*order).limit(sample).union(labels.where("label = 1").orderBy(*order).limit(sample))
    picked = F.broadcast(park(picked, "quality-picked"))  # 2 * sample rows at most
    found = inputs(docs, "doc_id").join(picked, "doc_id").select("doc_id", "text", "n_chars", "label").repartition(8)

    def reduce(batches):
        for batch in batches:
            for a, b, rows, columns, values, stats in features(batch.column("text"), _sizes(batch, "n_chars")):
                order = np.argsort(rows, kind="stable")
                cut = np.searchsorted(rows[order], np.arange(b - a + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[order])) for x in (columns.astype(np.int32), values)]
                figure = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * STATS, pa.int32()), pa.array(stats.ravel()))
                yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("label")[a:b], *lists, figure], ["doc_id", "label", "columns", "values", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # 2 * sample texts at most, each of 2**BITS + 1 features at most
    seen = found.mapInArrow(reduce, f"doc_id {kind}, label int, columns array<int>, `values` array<double>, stats array<double>").toPandas()
    seen = seen.sort_values("doc_id", kind="stable").reset_index(drop=True)
    if seen["label"].nunique() < 2:
        return constant(counts[1] / (counts[0] + counts[1]))
    rows = np.repeat(np.arange(len(seen)), [len(x) for x in seen["columns"]])
    label = seen["label"].to_numpy(np.float64)
    machine = train(rows, np.concatenate(list(seen["columns"])), np.concatenate(list(seen["values"])), np.stack(list(seen["stats"])), label)
    machine.bias += (1 - LEAN) * np.log(counts[1] / counts[0]) - np.log(label.sum() / (len(label) - label.sum()))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    kind = docs.schema["doc_id"].dataType
    light = Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32), machine.mean, machine.spread)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(light.scores(batch.column("text"), _sizes(batch, "n_chars")))], ["doc_id", "score"])

    return inputs(docs, "doc_id").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")


def training(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows to learn from: those that are not held out."""
    return labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, training(labels)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
