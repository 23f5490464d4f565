"""The as-of join against a plain scan, cut by time in one to many slices; Thompson draws under any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.operators import asof as A
from quillmine.operators import sampling as T


@pytest.mark.parametrize("slices", [None, 1, 7, 300])
def test_last_change_before_each_row(spark, slices):
    rng = random.Random(2)
    user = lambda: 1 if rng.random() < 0.7 else rng.choice([2, 3, None])  # noqa: E731  one user has most of the rows
    rows = [(user(), rng.choice([None, *range(200)]), k) for k in range(400)]
    changes = [(user(), rng.choice([None, *range(-20, 190)]), k, f"v{k}") for k in range(150)]
    want = set()
    for key, at, i in rows:
        fit = [c[1:] for c in changes if key is not None and at is not None and c[0] == key and c[1] is not None and c[1] <= at]
        want.add((i, key, at, max(fit) if fit else None))
    left = spark.createDataFrame([(*r, "z", 1) for r in rows], "key long, at long, id long, change string, slice int").withColumnRenamed("change", "a.b").repartition(3)
    right = spark.createDataFrame(changes, "key long, at long, order long, value string")
    out = A.last_before(left, right, slices)
    assert out.columns == ["key", "at", "id", "a.b", "slice", "change"]
    assert {(r["id"], r["key"], r["at"], tuple(r["change"]) if r["change"] else None) for r in out.collect()} == want


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, 5, 1)], "key long, at long, id long"), spark.createDataFrame([], "key long, at long, order long, value string")
    assert A.last_before(left, right).first()["change"] is None and A.last_before(left.limit(0), right).count() == 0
    assert [r["stale"] for r in A.consistency(left, spark.createDataFrame([(1, 9, 1, "x")], right.schema), 10).collect()] == [True]
    assert [r["stale"] for r in A.consistency(left, spark.createDataFrame([(1, 5, 1, "x")], right.schema), 10).collect()] == [False]


def cells(spark):
    return spark.createDataFrame([(k, lv, 1 + (k * 7 + lv * 3) % 9, 1 + (k + lv) % 5) for k in range(300) for lv in T.LEVELS] + [(900, lv, 1, 1) for lv in T.LEVELS], "key long, level int, alpha long, beta long")


def test_draws_do_not_depend_on_partitions(spark):
    runs = [{tuple(r) for r in T.choose(cells(spark).repartition(n), 42).collect()} for n in (3, 200)]
    assert runs[0] == runs[1] and len(runs[0]) == 301
    assert runs[0] != {tuple(r) for r in T.choose(cells(spark), 43).collect()}
    prior = next(r for r in runs[0] if r[0] == 900)
    assert prior[1] == 0 and prior[2] is None and {r[1] for r in runs[0]} == set(T.LEVELS)


@pytest.mark.parametrize(("a", "b"), [(1, 1), (2, 5), (40, 3)])
def test_moments(spark, a, b):
    n = 20_000
    x = spark.range(n).select(T.beta_draw(F.col("id"), F.lit(0), F.lit(a), F.lit(b), 5).alias("x")).toPandas().x.to_numpy()
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    assert abs(x.mean() - mean) < 5 * np.sqrt(var / n) and abs(x.var() / var - 1) < 0.05 and 0 <= x.min() and x.max() <= 1


def test_posteriors(spark):
    out = T.posteriors(spark.createDataFrame([(1, 0, True), (1, 0, False), (1, 0, True), (1, 9, True), (None, 0, True), (2, None, True), (2, 3, None)], "key long, level int, ok boolean"))
    assert {tuple(r) for r in out.collect()} == {(1, 0, 3, 2), (1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (2, 0, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1), (2, 3, 1, 1)}
