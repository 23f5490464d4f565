"""Mixing sources to target weights.

Each source's size (words) is summed, targets are dealt by weight and capped, and every document is repeated
floor(target / size) times plus one hash-seeded Bernoulli copy whose probability is the fraction.

Cases: a null source is a source of its own, last in order; a null or empty text has size 0 and takes 0; a source
of size 0 has target 0; repeated rows get equal draws; a null doc_id draws as the empty string; an empty table
gives an empty result. Further columns pass through under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, carrying, checked_broadcast, park, quoted

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source of sizes (source, size): source, source_size, target, rate.

    Sources are numbered by code point, null last; weights repeat along the numbers. Targets share the total and stop
    at cap times the source's size; what is above is shared again by weight. Closed form: in order of size over
    weight, the capped sources come first, and the rest share what these leave. One row per source goes through the
    windows, after a pre-aggregated sum.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    per = per.withColumn("number", number).withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    per = per.withColumns(
        {
            "place": F.row_number().over(order),
            "before": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    share = (F.col("total") - F.col("before")).cast("double") / F.col("left")
    over = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.when(F.col("limit") > share * F.col("weight"), F.struct("place", share.alias("share")))
    per = per.withColumn("free", F.min(free).over(over))
    capped = F.col("free").isNull() | (F.col("place") < F.col("free.place"))
    target = F.when(capped, F.col("limit").cast("double")).otherwise(F.col("free.share") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on key and seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(key: Column, rate: Column, seed: int = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def plan_for(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(sizes per document, targets per source), both written: texts are read once for them."""
    sizes = park(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    return sizes, park(targets(sizes, weights, cap), "targets")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, rate."""
    sizes, plan = plan_for(docs, weights, cap)
    a, b = sizes.alias("a"), checked_broadcast(plan).alias("b")
    n = copies(F.col("a.doc_id"), F.col("b.rate"), seed)
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.doc_id", "a.size", "b.source_size", "b.target", (n * F.col("a.size")).alias("taken"), n.alias("copies"), "b.rate"
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it, with a column copy_number from 1 (replaced if docs has one)."""
    return _copied(docs.select([quoted(c) for c in docs.columns if c.lower() != "copy_number"]), weights, cap, seed)


@carrying("doc_id", "text", "source")
def _copied(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    _, plan = plan_for(docs, weights, cap)
    b = checked_broadcast(plan.select(F.col("source").alias("__source"), F.col("rate").alias("__rate")))
    out = docs.join(b, docs["source"].eqNullSafe(b["__source"]))
    n = copies(docs["doc_id"], F.col("__rate"), seed)
    out = out.withColumn("__n", n).where("__n > 0")
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("copy_number"))
