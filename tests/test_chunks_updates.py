"""Chunks against a plain rolling loop, updates with nulls, long chains, and the best of tied vectors."""

from collections import Counter

from pyspark.sql import functions as F

from quillmine.operators import dense, graph, project, store
from quillmine.plans.bindings import table

SF = "/root/testdata/sf0.001"


def plain_cuts(data, window=64, least=128, most=1024):
    edges, x, top = [0], 0, pow(263, window, 1 << 32)
    for i, byte in enumerate(data):
        x = (x * 263 + byte + 1 - (top * (data[i - window] + 1) if i >= window else 0)) % (1 << 32)
        size = i + 1 - edges[-1]
        marked = i + 1 >= window and ((x * 2654435761 % (1 << 64)) >> 16) % 256 == 0
        if i + 1 < len(data) and size >= least and (marked or size == most):
            edges.append(i + 1)
    return edges


def test_chunks_and_their_registry(spark):
    docs = table(spark, SF, "documents").select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL AND text <> ''")
    got, parts = {}, Counter()
    found = project.chunks(docs)
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["place"], r["start"], r["size"], r["fingerprint"]))
    alike = {}
    for r in docs.collect():
        data, rows = r["text"].encode(), sorted(got[r["id"]])
        assert [x[1] for x in rows] == plain_cuts(data)
        assert [x[0] for x in rows] == list(range(len(rows))) and sum(x[2] for x in rows) == len(data)
        for _, start, size, fingerprint in rows:
            assert alike.setdefault(fingerprint, data[start : start + size]) == data[start : start + size]
            parts[fingerprint] += 1
    assert len(set(alike.values())) == len(alike)
    assert {(r["fingerprint"], r["seen"]) for r in project.chunk_registry(found).collect()} == {(f, n) for f, n in parts.items() if n > 1}


def test_updates_keep_or_set_nulls(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (None, 7, "c")], "id long, importance long, symbol string")
    changes = spark.createDataFrame([(1, None, "x"), (None, 0, "y"), (9, 1, "z")], "id long, importance long, symbol string")
    for nulls, first in ((False, (1, 5, "x")), (True, (1, None, "x"))):
        assert set(map(tuple, store.update(rows, changes, ["importance", "symbol"], nulls).collect())) == {first, (2, 6, "b"), (None, 7, "c")}


def test_chains_longer_than_a_power_of_two_and_ends_out_of_reach(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(21)] + [(0, 30), (30, 2), (50, 51)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert sorted(map(tuple, graph.call_chain(edges, start, 21).collect())) == [(k, k) for k in range(22)]
    assert graph.call_chain(edges, start, 51).count() == 0
    assert list(map(tuple, graph.call_chain(edges, start, 0).collect())) == [(0, 0)]


def test_best_of_ties_are_those_of_smallest_id(spark):
    data = [(i, [float(i % 3 == 0), 1.0]) for i in range(40)] + [(None, [1.0, 1.0])]
    vectors = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    got = {}
    for r in dense.top(vectors, vectors.where("id % 7 = 0"), 4, itself=False, least=1.0).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"], r["score"]))
    plain = dict(data[:-1])
    for q in range(0, 40, 7):
        score = {i: sum(x * y for x, y in zip(plain[q], v)) for i, v in plain.items() if i != q}
        best = sorted((-s, i) for i, s in score.items() if s >= 1.0)[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    # fewer rows than asked for, and itself among them
    few = dense.top(vectors.where("id < 3"), vectors.where("id = 0"), 9).collect()
    assert sorted((r["place"], r["id"]) for r in few) == [(1, 0), (2, 1), (3, 2)]
