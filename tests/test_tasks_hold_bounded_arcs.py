"""Arcs that are read again and again lie in files whose bytes bound their rows, whatever the numbers of nodes pack to."""

import os

from quillmine.operators import graph as G


def test_files_of_arcs_take_eight_bytes_a_number(spark, monkeypatch):
    written = []
    keep = G.plain
    monkeypatch.setattr(G, "plain", lambda df: written.append(keep(df)) or written[-1])
    edges = spark.range(50_000).selectExpr("id % 10 AS src", "10 + id AS dst")
    G.components(edges), G.label_propagation(edges, 1)
    assert [w.count() for w in written] == [100_000, 100_000]
    for w in written:
        assert sum(os.path.getsize(f.removeprefix("file://")) for f in w.inputFiles()) > 16 * 100_000
