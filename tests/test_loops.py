"""Loops that go on until nothing is left."""

from quillmine.operators import graph as G


def test_long_chain_is_reached_to_its_end(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    seed = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["depth"] for r in G.bfs(e, seed).collect()} == {k: k for k in range(61)}


def test_many_linked_cycles_and_self_loops(spark):
    n = 32  # descending ids: each round takes one cycle off
    pairs = [(2 * (n - k), 2 * (n - k) + 1) for k in range(n)]
    e = [x for a, b in pairs for x in ((a, b), (b, a))] + [(p[0], q[0]) for p, q in zip(pairs, pairs[1:])] + [(500, 500), (4, 4)]
    d = spark.createDataFrame(e, "src long, dst long")
    want = {x: a for a, b in pairs for x in (a, b)}
    assert {r["node"]: r["cycle"] for r in G.cycles(d, loops=True).collect()} == want | {500: 500}
