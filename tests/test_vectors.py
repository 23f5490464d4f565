"""Clusters of vectors against all pairs."""

import random

from quillmine.operators import store as W


def test_all_pairs_of_vectors(spark):
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    rows = [(k, [x + 0.42 * r.gauss(0, 1) for x in base[k % 40]]) for k in range(400)]
    norm = [sum(x * x for x in v) ** 0.5 for _, v in rows]
    root = list(range(len(rows)))
    for a, u in rows:
        for b, v in rows[a + 1 :]:
            if root[a] != root[b] and sum(x * y for x, y in zip(u, v)) >= 0.9 * norm[a] * norm[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    got = W.vector_clusters(spark.createDataFrame(rows, "id long, embedding array<double>"), singles=True)
    assert {r["id"]: r["cluster"] for r in got.collect()} == dict(enumerate(root)) and 40 < len(set(root)) < 400
