"""Snapshots against a full outer join, reading only ranges that differ; liveness against a plain worklist."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmine.operators import liveness as L
from quillmine.operators import snapshots as P
from quillmine.plans import state_queries as Q

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, n, "z") for k, (v, n) in rows.items()], "id long, value string, `a.b` double, leaf string").repartition(3)


@pytest.mark.parametrize("named", [P.NAMED, 1])
def test_compare_equals_a_full_join(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(P, "NAMED", named)
    rng = random.Random(4)
    one = {rng.randrange(-50_000, 90_000): (rng.choice([None, "x", "é", ""]), rng.random()) for _ in range(900)}
    two = dict(one)
    keys = sorted(one)
    for k in keys[:30]:
        del two[k]
    for k in keys[500:540]:
        two[k] = ("new", two[k][1])
    two[keys[600]] = (two[keys[600]][0], None)
    two |= {200_000 + k: ("added", 1.0) for k in range(20)}
    book = P.Snapshots(spark, f"file://{tmp_path}/s")
    book.save("one", frame(spark, one), "id")
    book.save("two", frame(spark, two), "id")
    book.save("again", frame(spark, one).repartition(7), "id")
    want = {(k, "added" if k not in one else "removed" if k not in two else "changed") for k in one.keys() | two.keys() if one.get(k) != two.get(k)}
    assert {(r["key"], r["change"]) for r in book.compare("one", "two").collect()} == want
    assert book.equal("one", "again") and book.compare("one", "again").count() == 0 and not book.equal("one", "two")


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    book = P.Snapshots(spark, f"file://{tmp_path}/s")
    one = {k: ("v", float(k)) for k in range(0, 200_000, 50)}
    book.save("one", frame(spark, one), "id")
    book.save("two", frame(spark, one | {100_000: ("w", 0.0)}), "id")
    parts = book._differing("one", "two", "part")
    leaves = book._differing("one", "two", "leaf", parts)
    assert leaves == [100_000 // P.WIDTH] and parts == [leaves[0] // P.FAN]
    rows = book.changed_rows("one", parts, leaves)
    files = {re.search(r"/part=(-?\d+)/", r["f"])[1] for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files == {str(parts[0])} and rows.count() <= P.WIDTH
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and re.search(r"PushedFilters: \[[^\]]*leaf", plan)


def test_rows_without_a_key_and_doubles(spark, tmp_path):
    book = P.Snapshots(spark, f"file://{tmp_path}/s")
    schema = "id long, value string"
    book.save("a", spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], schema), "id")
    book.save("b", spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], schema), "id")
    book.save("e", spark.createDataFrame([], schema), "id")
    assert book.compare("a", "b").count() == 0 and [tuple(r)[:2] for r in book.compare("e", "a").collect()] == [(1, "added")]


def worklist(rules, roots):
    alive, again = set(roots), True
    while again:
        more = {h for h, body in rules if h not in alive and set(body) <= alive}
        again = bool(more)
        alive |= more
    return alive


def test_living_against_a_worklist(spark):
    rng = random.Random(8)
    rules = [(rng.randrange(80), [rng.randrange(80) for _ in range(rng.randrange(1, 4))]) for _ in range(130)] + [(200, []), (201, [200, 200]), (202, [203]), (203, [202]), (204, [200, 999])]
    roots = [1, 2, 3, 5, 8]
    df = spark.createDataFrame([*rules, (None, [1])], "head long, body array<long>").repartition(4)
    got = {r["node"]: r["round"] for r in L.living(df, spark.createDataFrame([(r,) for r in [*roots, None]], "node long")).collect()}
    want = worklist(rules, [*roots, 200])
    assert set(got) == want and max(got.values()) > 1 and not {202, 203, 204} & set(got) and got[201] == 1
    assert {r["node"] for r in L.dead(df, spark.createDataFrame([(r,) for r in roots], "node long")).collect()} == {h for h, _ in rules} - want


def test_liveness_query_over_whole_tables(spark):
    rules = [(r["head"], r["body"]) for r in Q.rules(spark, SF).collect()]
    got = {r["node"]: r["round"] for r in Q.QUERIES["dynamic_liveness"](spark, SF).collect()}
    assert set(got) == worklist(rules, [n for n, r in got.items() if r == 0]) and sum(r == 0 for r in got.values()) == 1


def test_rules_travel_as_numbers(spark, exchanged):
    rules = [(n + 1, [n, (n * 7919) % 20000]) for n in range(20000)]
    df, before = spark.createDataFrame(rules, "head long, body array<long>").repartition(4), exchanged()
    L.living(df, spark.createDataFrame([(-1,)], "node long")).count()
    first = exchanged()[0] - before[0]
    before = exchanged()
    L.living(df, spark.createDataFrame([(n,) for n in range(0, 20000, 2)], "node long")).count()
    assert first < 1_500_000 and exchanged()[0] - before[0] < 4_000_000
