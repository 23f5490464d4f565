"""As-of join: to every row, what was last known of its key at its time. And what such a join tells of notes that have aged.

Rows and changes are put together and a running last value is taken by key and time. A key with most of the rows is cut
by time: the running value is taken within slices of time, and the last change of each slice is carried to the slices
after it, which takes one row a key and slice. So no task orders more than a slice of a key.

Cases: a change at a row's very time counts (of several, the one of largest order); rows without a change before them
get nulls; rows with a null key or time get nulls, such changes are never found; of further columns those of the rows pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a slice of time is meant to hold, if they came evenly.
SLICE = 1 << 20


def last_before(rows: DataFrame, changes: DataFrame, slices: int | None = None) -> DataFrame:
    """rows (key, at, and others) with change: the last of changes (key, at, order, value) at or before each, as a struct (at, order, value)."""
    others = [c for c in rows.columns if c not in ("key", "at")]
    value = F.struct("at", "order", "value")
    left = rows.select("key", "at", F.lit(None).cast(changes.schema["order"].dataType).alias("order"), F.lit(1).alias("kind"), F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("row"), F.lit(None).alias("change"))
    right = changes.where("key IS NOT NULL AND at IS NOT NULL").select("key", "at", "order", F.lit(0).alias("kind"), F.lit(None).alias("row"), value.alias("change"))
    span = rows.agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n")).first()
    slices = slices or max(1, -(-span["n"] // SLICE))
    width = max(1, -(-((span["b"] or 0) - (span["a"] or 0) + 1) // slices))
    known = F.col("key").isNotNull() & F.col("at").isNotNull()
    part = F.when(known, F.floor((F.col("at") - (span["a"] or 0)) / width)).cast("long")
    # rows that can have no change are dealt at will, as they would share one key
    both = left.unionByName(right).withColumn("slice", F.coalesce(part, F.pmod(F.monotonically_increasing_id(), F.lit(1000)) - 10_000))
    order = Window.partitionBy("key", "slice").orderBy("at", "kind", "order").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("here", F.last("change", ignorenulls=True).over(order))
    ends = right.withColumn("slice", part).groupBy("key", "slice").agg(F.max("change").alias("end"))
    # what a slice that has rows inherits: the last end of the slices before it
    marks = both.where(known).select("key", "slice").distinct().join(ends, ["key", "slice"], "left")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("key", "slice", F.last("end", ignorenulls=True).over(before).alias("carried"))
    out = inside.where("kind = 1").join(carried, ["key", "slice"], "left")
    change = F.when(known, F.coalesce("here", "carried")).alias("change")
    return out.select("key", "at", *[F.col("row").getField(c).alias(c) for c in others], change)


def consistency(notes: DataFrame, changes: DataFrame, now: int, slices: int | None = None) -> DataFrame:
    """notes (id, key, at) with the change of their key last known when they were written and now, and whether they are suspected stale: something has changed since."""
    then = last_before(notes.select("key", "at", "id"), changes, slices).select("id", "key", "at", F.col("change.at").alias("seen_at"), F.col("change.value").alias("seen"))
    today = last_before(notes.select("key", F.lit(now).cast("long").alias("at"), "id"), changes, slices).select("id", F.col("change.at").alias("now_at"), F.col("change.value").alias("now"))
    return then.join(today, "id").withColumn("stale", F.coalesce(F.col("now_at") > F.col("at"), F.lit(False)))
