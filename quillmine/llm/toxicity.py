"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is seen as its code points in lower case (Unicode), white space made a blank; n-grams of 3 to 8 code points
are hashed into 2**BITS buckets, and a feature is present or absent. On a bounded sample of labelled texts
(SAMPLE of each class, picked by hash) each bucket gets the log ratio of its smoothed frequencies in the two classes;
the TOP buckets by chi-square carry weight, and a logistic regression is fitted on presence times ratio. Scoring
covers every whole text and ships only the weights (2**BITS floats).

Cases: null and empty texts have no n-grams and get the score of the intercept alone; labels that are null, or ids
without a document, are not used, nor is a document that is labelled both 0 and 1; with labels of one class only the score is that class's share, without any 0.0;
repeated documents get equal scores; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, carrying, light_batches, park, texts

BITS = 18
GRAMS = (3, 4, 5, 6, 7, 8)
#: Labelled texts of each class that the fit uses at most.
SAMPLE = 2000
TOP = 4096
THRESHOLD = 0.7
#: Bytes of text in one vectorised pass; each n-gram of it takes some 60 bytes meanwhile.
PASS_BYTES = 1 << 16
#: How far the intercept leans from the classes' shares in the labels (0) to equal shares (1).
LEAN = 0.75


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def codes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last, code points, n+1 offsets) of blocks of texts, in lower case and with blanks for white space; null counts as empty."""
    _, offsets = texts(column)
    for a, b in blocks(offsets, PASS_BYTES):
        part = pc.utf8_lower(pc.fill_null(column[a:b], ""))
        flat = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), np.uint32)
        flat = np.where((flat >= 9) & (flat <= 13), np.uint32(32), flat)
        yield a, b, flat, np.concatenate([[0], np.cumsum(pc.utf8_length(part).to_numpy(zero_copy_only=False), dtype=np.int64)])


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket at every place, and how many places of each row hold a whole n-gram."""
    value = np.zeros(len(data), np.uint32)
    lengths = np.diff(offsets)
    for n in range(1, max(GRAMS) + 1):
        if len(data) < n:
            return
        value = value[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (mixed + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS), np.maximum(lengths - n + 1, 0)


def present(flat: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct row << BITS | bucket, sorted; only buckets wanted, if given."""
    found = []
    for bucket, places in grams(flat, offsets):
        at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at - offsets[row] < places[row]
        found.append((row[inside] << BITS) | bucket[at[inside]].astype(np.int64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        wanted = self.weights != 0
        out = np.full(len(column), self.intercept)
        for a, b, flat, offsets in codes(column):
            keys = present(flat, offsets, wanted)
            out[a:b] += np.bincount(keys >> BITS, self.weights[keys & ((1 << BITS) - 1)], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, decay: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on a sparse matrix, by accelerated gradient steps; the intercept is free."""
    n = len(labels)
    weights, bias = np.zeros(width), 0.0
    ahead, ahead_bias, t = weights, bias, 1.0
    lipschitz = 0.25 * (np.bincount(rows, values**2, n).max(initial=0) + 1) + decay / n
    for _ in range(steps):
        z = np.bincount(rows, values * ahead[columns], n) + ahead_bias
        error = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - labels
        step = np.bincount(columns, values * error[rows], width) / n + decay / n * ahead
        new, new_bias = ahead - step / lipschitz, ahead_bias - error.mean() / lipschitz
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / after * (new - weights), new_bias + (t - 1) / after * (new_bias - bias)
        weights, bias, t = new, new_bias, after
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labels (doc_id, label 0 or 1) and the texts of docs."""
    docs = docs.select("doc_id", "text")
    labels = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("most"))
    labels = labels.where("label = most").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.0
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))) if 0 < share < 1 else (700.0 if share else -700.0))
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = labels.where("label = 0").orderBy(*order).limit(sample).union(labels.where("label = 1").orderBy(*order).limit(sample))
    picked = F.broadcast(park(picked.withColumnRenamed("doc_id", "__id"), "picked"))  # 2 * sample rows at most
    rows = park(docs.join(picked, docs["doc_id"] == F.col("__id")).select("text", "label").repartition(8), "sample")

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for a, b, flat, offsets in codes(batch.column("text")):
                keys = present(flat, offsets)
                for k in (0, 1):
                    seen[k] += np.bincount((keys & ((1 << BITS) - 1))[label[a:b][keys >> BITS] == k], minlength=1 << BITS)
        at = np.flatnonzero(seen.sum(0))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.record_batch([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], ["bucket", "no", "yes"])

    seen = rows.mapInArrow(count, "bucket long, no long, yes long").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    with light_batches(docs.sparkSession):
        seen = park(seen, "buckets")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = counts[1] / total
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    n0, n1 = sizes[0], sizes[1]
    sums = seen.agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"), F.count("*").alias("buckets")).first()
    both = F.col("no") + F.col("yes")
    chance = both * (n1 / (n0 + n1))
    strength = F.pow(F.col("yes") - chance, 2) / (chance * (1 - both / (n0 + n1 + 1)) + 1)
    best = seen.orderBy(F.desc(strength), "bucket").limit(TOP).collect()
    bucket, no, yes = (np.array([r[c] for r in best], t) for c, t in (("bucket", np.int64), ("no", float), ("yes", float)))
    ratio = np.log((yes + 1) / (sums["yes"] + sums["buckets"])) - np.log((no + 1) / (sums["no"] + sums["buckets"]))
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))

    def reduce(batches):
        for batch in batches:
            chosen = []
            for a, b, flat, offsets in codes(batch.column("text")):
                keys = present(flat, offsets, place >= 0)
                cut = np.searchsorted(keys >> BITS, np.arange(b - a + 1))
                chosen += [place[keys[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)].tolist() for i in range(b - a)]
            yield pa.record_batch([batch.column("label"), pa.array(chosen, pa.list_(pa.int32()))], ["label", "features"])

    # 2 * sample rows of TOP small numbers at most
    with light_batches(docs.sparkSession):
        sampled = rows.mapInArrow(reduce, "label int, features array<int>").toPandas()
    row = np.repeat(np.arange(len(sampled), dtype=np.int32), [len(x) for x in sampled["features"]])
    column = np.concatenate([np.asarray(x, np.int32) for x in sampled["features"]])
    label = sampled["label"].to_numpy(float)
    weights, bias = logistic(row, column, ratio.astype(np.float32)[column], label, len(bucket))
    bias += (1 - LEAN) * np.log(counts[1] / counts[0]) - np.log(n1 / n0)
    full = np.zeros(1 << BITS)
    full[bucket] = weights * ratio
    return Model(full, float(bias))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns keep of docs, and score. Only texts go to Python, each once, and only scores come back."""
    weights, intercept = model.weights.astype(np.float32), model.intercept

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(weights.astype(np.float64), intercept)
        for column in columns:
            yield pa.array(own.scores(column))

    return docs.select(*keep, run("text").alias("score"))


def training(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows to learn from: those that are not held out."""
    return labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, training(labels))
    out = score(docs.select("doc_id", "text"), model, "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@carrying("doc_id", "text")
def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    return score(docs, fit(docs, training(labels)), *docs.columns).where(F.col("score") < THRESHOLD).select(*docs.columns)
