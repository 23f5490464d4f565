"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased. A seed is the hash of the words that a mask keeps of those
it spans; a mask ignores the other positions, so a substitution there leaves the seed alone. Which masks an item needs
depends on its length: those of FAMILIES keep a seed whatever words an overlap that counts may have replaced. Seeds
of the benchmark are joined with the seeds at every position of every document, under the masks that the benchmark
needs. Around each hit the two word rows are laid on that diagonal, and the overlap counts if some stretch of LEAST
words (all words of a shorter item) agrees in SHARE of its positions. Seeds that are too many to broadcast are joined
by a shuffle in which documents' seeds are salted, so that a passage found everywhere does not meet in one task.

Cases: null and empty texts have no seeds; items of fewer than SHORTEST words are no passages and are never found;
repeated rows of documents give one result row for each doc_id and item; an empty table gives an empty result; the
ids may be null. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carrying, checked_broadcast, let, measured_bytes, park

#: Positions that each mask keeps.
MASKS = ((0, 1, 2, 3, 7), (0, 2, 5, 6, 7), (0, 1, 3, 4), (0, 1, 2), (0, 1, 3))
#: (fewest words, masks) of items, longest first. Every replacement of words that SHARE allows leaves one of the masks a seed.
FAMILIES = ((12, (0, 1)), (10, (0, 1, 2)), (8, (2,)), (5, (3, 4)))
SHORTEST = FAMILIES[-1][0]
LEAST = 13
SHARE = 0.8
#: Benchmark seeds up to so many bytes are broadcast; beyond, the join is shuffled, documents' seeds dealt in SALTS ways.
SEED_BYTES = 64 << 20
SALTS = 16


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def seeds(words: Column, masks: list[int]) -> Column:
    """(mask, at, seed) at every position under the given masks."""

    def under(k: int) -> Column:
        n = F.size(words) - MASKS[k][-1]
        seed = lambda i: F.struct(F.lit(k).alias("mask"), (i - 1).alias("at"), F.xxhash64(F.lit(k), *[F.get(words, i + (o - 1)) for o in MASKS[k]]).alias("seed"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), seed)).otherwise(F.array().cast("array<struct<mask:int,at:int,seed:bigint>>"))

    return F.concat(*map(under, masks))


def placed(table: DataFrame, key: str, masks: list[int]) -> DataFrame:
    """(key, mask, at, seed, n) for every seed, n the words of the row; the words stay behind, as each row would carry all of them."""
    found = lambda words: F.struct(seeds(words, masks).alias("seeds"), F.size(words).alias("n"))
    rows = table.select(key, let(tokens(F.col("text")), found).alias("found"))
    return rows.select(key, "found.n", F.inline("found.seeds"))


def needed() -> Column:
    """Whether an item of n words needs the mask."""
    out = F.when(F.lit(False), False)
    for words, masks in FAMILIES:
        out = out.when(F.col("n") >= words, F.col("mask").isin(list(masks)))
    return F.coalesce(out, F.lit(False))


def agreement(ours: Column, theirs: Column, shift: Column) -> Column:
    """0 or 1 for each word of theirs: whether the word of ours at its place plus shift is equal."""
    return F.transform(theirs, lambda w, i: F.when(F.get(ours, i + shift) == w, 1).otherwise(0))


def best_stretch(equal: Column, least: int = LEAST) -> Column:
    """Most agreeing positions in any stretch of least words (of all, if fewer)."""
    width = F.least(F.size(equal), F.lit(least))
    first = F.aggregate(F.slice(equal, F.lit(1), width), F.lit(0), lambda a, x: a + x)
    step = lambda a, i: F.struct(
        (a["now"] + F.get(equal, i) - F.get(equal, i - width)).alias("now"),
        F.greatest(a["most"], a["now"] + F.get(equal, i) - F.get(equal, i - width)).alias("most"),
    )
    rest = F.when(F.size(equal) > width, F.sequence(width, F.size(equal) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, F.struct(first.alias("now"), first.alias("most")), step, lambda a: a["most"])


def overlaps(docs: DataFrame, benchmark: DataFrame, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, agreeing (most words in a stretch), matched (words on the diagonal), item_words."""
    items = placed(benchmark.select("item_id", "text"), "item_id", list(range(len(MASKS)))).where(needed())
    items = park(items.select("item_id", "mask", F.col("at").alias("item_at"), "seed"), "seeds")
    masks = sorted(r["mask"] for r in items.select("mask").distinct().collect()) or [0]  # a few numbers
    ours = placed(docs.select("doc_id", "text"), "doc_id", masks).select("doc_id", "at", "seed")
    if measured_bytes(items) <= seed_bytes:
        pairs = ours.join(F.broadcast(items), "seed")
    else:
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = ours.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    pairs = park(pairs.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    here = pairs.select(F.col("doc_id").alias("__doc"), F.col("item_id").alias("__item"), "shift")
    hits = docs.select("doc_id", "text").join(checked_broadcast(here), F.col("doc_id").eqNullSafe(F.col("__doc")))
    hits = hits.select("doc_id", "text", "__item", "shift")
    there = park(benchmark.select("item_id", tokens(F.col("text")).alias("item")), "items")
    hits = hits.join(checked_broadcast(there), F.col("__item").eqNullSafe(F.col("item_id")))
    judged = lambda words: let(
        agreement(words, F.col("item"), F.col("shift")),
        lambda equal: F.struct(best_stretch(equal).alias("agreeing"), F.aggregate(equal, F.lit(0), lambda a, x: a + x).alias("matched")),
    )
    hits = hits.select("doc_id", "item_id", F.size("item").alias("item_words"), let(tokens(F.col("text")), judged).alias("judged"))
    hits = hits.select("doc_id", "item_id", "item_words", "judged.*")
    hits = hits.where(F.col("agreeing") >= F.ceil(F.least(F.col("item_words"), F.lit(LEAST)) * F.lit(SHARE)))
    return hits.groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.max("matched").alias("matched"), F.first("item_words").alias("item_words"))


@carrying("doc_id", "text")
def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps an item. The key is the text's digest, so rows without an id and repeated rows are judged alike."""
    keyed = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_id"), "text")
    bad = park(overlaps(keyed, benchmark).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(checked_broadcast(bad), F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col("__bad"), "left_anti")
