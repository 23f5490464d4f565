"""Runs against a plain scan of all shifts, over whole texts and dealt by ranges of shifts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24, min_exp=3):
    out = {}
    for p in range(1, len(w) // min_exp + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, min_exp * p):
                out.setdefault((i, j - i + p), p)  # shifts rise, so the first is the smallest
            i = max(j, i + 1)
    return sorted((s, p, n) for (s, n), p in out.items())


def plain(doc_id, text, planted=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, p, m in runs for i in range(s + p, s + m)}
    top = (None, None, None)
    for s, p, m in runs:
        if top[0] is None or m * top[2] > top[1] * p:
            top = (s, m, p)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{p}\n" for s, p, m in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_scan_of_many_rows_finds_the_runs_of_each():
    rng = np.random.default_rng(1)
    n = 0
    for _ in range(60):
        docs = []
        for _ in range(rng.integers(1, 6)):
            w = rng.integers(0, rng.integers(1, 5), int(rng.integers(0, 150))).tolist()
            for _ in range(rng.integers(0, 3)):
                p = int(rng.integers(1, 40))
                w += (rng.integers(0, 50, p).tolist() * 12)[: int(rng.integers(1, p * 8 + 30))] + rng.integers(0, 50, int(rng.integers(0, 20))).tolist()
            docs.append(w)
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
        runs = periods.scan(np.array(sum(docs, []), np.int64), offsets).tolist()
        got = [[(s, p, m) for r, s, m, p in runs if r == k] for k in range(len(docs))]
        want = [plain_runs(w) for w in docs]
        assert got == want
        n += sum(map(len, want))
    assert n > 100


@pytest.fixture(scope="module")
def many(spark, hard):
    rng = np.random.default_rng(8)
    base = hard.select("doc_id", "text", "key")
    rows = [(None, "a b " * 40, "k"), (None, "a b " * 40, "k"), (None, None, "k")]
    for k in range(20, 60):
        p = int(rng.integers(1, 30))
        w = [f"w{x}" for x in rng.integers(0, 9, int(rng.integers(0, 60)))] + [f"é{x}" for x in rng.integers(0, 90, p)] * int(rng.integers(1, 9)) + ["x"] * int(rng.integers(0, 40))
        rows.append((k, "\t".join(w), "k"))
    return base.union(spark.createDataFrame(rows, base.schema)).repartition(3)


@pytest.mark.parametrize(("long", "lags"), [(periods.LONG, periods.LAGS), (40, 7), (-1, 50)])
def test_runs_against_a_plain_scan(many, long, lags):
    some = many.where("doc_id is null or doc_id <> 6")  # its 30,000 words are too many for the plain scan
    want = [plain(r["doc_id"], r["text"]) for r in some.collect()]
    out = periods.repeats(some, periods.damage, long=long, lags=lags)
    got = [tuple(r) for r in out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[1] for w in want) > 20


def test_nothing_and_other_columns(spark, nothing):
    assert periods.repeats(nothing, periods.damage).count() == 0
    one = spark.createDataFrame([(1, "a " * 30, "x", 2, 3)], "doc_id long, text string, start string, key int, low int").withColumn("a.b", F.lit(1))
    assert [r["n_runs"] for r in periods.repeats(one).collect()] == [1] == [r["n_runs"] for r in periods.repeats(one, long=1).collect()]


def test_very_long_text(spark):
    w = [f"u{k}" for k in range(5000)] + [f"p{k}" for k in range(7000)] * 4 + ["z"] * 30
    docs = spark.createDataFrame([(3, " ".join(w))], "doc_id long, text string")
    for long in (periods.LONG, 1000):
        r = periods.repeats(docs, long=long, lags=2048).first()
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["n_dropped"]) == (2, 33000, 30, 1, 21029)
