"""Thompson sampling over levels: Beta draws from a counter-based generator, the same whatever the partitioning.

A draw is made by Philox, keyed by the row's and level's hash and the seed, so it depends on nothing else: no task order,
no number of partitions, no other row. Posteriors are Beta(1 + successes, 1 + failures), from counts; a row whose levels
are all at the prior takes level 0.

Cases: levels that a row has no outcome for are at the prior; outcomes of unknown levels and rows without a key are not
looked at; equal draws (none are to be expected) go to the smaller level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (0, 1, 2, 3)


def posteriors(outcomes: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(key, level, alpha, beta) of outcomes (key, level, ok), a row for every key and level."""
    seen = outcomes.where("key IS NOT NULL").groupBy("key").agg(
        *[F.count_if((F.col("level") == x) & F.col("ok")).alias(f"a{x}") for x in levels], *[F.count_if((F.col("level") == x) & ~F.col("ok")).alias(f"b{x}") for x in levels]
    )
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), (1 + F.col(f"a{x}")).alias("alpha"), (1 + F.col(f"b{x}")).alias("beta")) for x in levels]))
    return seen.select("key", cells.alias("cell")).select("key", "cell.*")


def beta_draw(key: Column, level: Column, alpha: Column, beta: Column, seed: int) -> Column:
    """A draw of Beta(alpha, beta) that key, level and seed fix."""

    @F.pandas_udf("double")
    def draw(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, a, b in columns:
            own = name.to_numpy(np.int64).view(np.uint64)
            yield pd.Series([np.random.Generator(np.random.Philox(key=np.array([k, np.uint64(seed)], np.uint64))).beta(x, y) for k, x, y in zip(own, a, b)], dtype="float64")

    return draw(F.xxhash64(key.cast("string"), level.cast("int")), alpha.cast("double"), beta.cast("double"))


def choose(cells: DataFrame, seed: int) -> DataFrame:
    """(key, level, draw): each key's level of largest draw; level 0, without a draw, if all of posteriors() are at the prior."""
    drawn = cells.withColumn("draw", beta_draw(F.col("key"), F.col("level"), F.col("alpha"), F.col("beta"), seed))
    best = drawn.groupBy("key").agg(F.max(F.struct("draw", (-F.col("level")).alias("least"))).alias("best"), F.max((F.col("alpha") != 1) | (F.col("beta") != 1)).alias("known"))
    return best.select("key", F.when(F.col("known"), -F.col("best.least")).otherwise(0).alias("level"), F.when(F.col("known"), F.col("best.draw")).alias("draw"))
