"""Local moving: modularity in whole numbers after every sweep, no gain left at the end, and the same result however edges are dealt."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmine.operators import communities as C
from quillmine.operators.graph import cut
from quillmine.plans import graph_queries as Q

SF = "/root/testdata/sf0.001"


def neighbours(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    return near


def plain_q(near, label):
    """m2 ** 2 times modularity, a whole number."""
    m2 = sum(map(len, near.values()))
    inside = sum(label[a] == label[b] for a in near for b in near[a])
    total = Counter()
    for a in near:
        total[label[a]] += len(near[a])
    return inside * m2 - sum(x * x for x in total.values())


def gains(near, label):
    m2 = sum(map(len, near.values()))
    total = Counter()
    for a in near:
        total[label[a]] += len(near[a])
    out = []
    for a in near:
        votes, d = Counter(label[b] for b in near[a]), len(near[a])
        stay = votes[label[a]] * m2 - d * (total[label[a]] - d)
        out += [(k * m2 - d * total[c] - stay, a, c) for c, k in votes.items() if c != label[a]]
    return out


def cliques():
    """Ten cliques of 4 to 13 nodes in a ring, a hub that touches all of them, a pair and a loop."""
    out, first = [], []
    for k in range(10):
        own = [1000 * k + i for i in range(4 + k)]
        out += [(a, b) for a in own for b in own if a < b]
        first.append(own[0])
    out += list(zip(first, first[1:] + first[:1])) + [(77_777, f) for f in first]
    return out + [(90_001, 90_000), (90_000, 90_001), (5, 5), (95_000, 95_000)]


def random_graph():
    rng = np.random.default_rng(12)
    return [(int(a), int(b)) for a, b in zip(rng.integers(0, 25, 800) * rng.integers(1, 9, 800), rng.integers(0, 200, 800))]


@pytest.mark.parametrize("graph", [cliques, random_graph])
def test_modularity_never_falls_and_no_gain_is_left(spark, graph):
    pairs = graph()
    near = neighbours(pairs)
    df = spark.createDataFrame(pairs, "src long, dst long")
    course = []
    state = C.local_moving(df, sweeps=60, watch=lambda s: course.append({r["node"]: r["community"] for r in s.collect()}))
    label = {r["node"]: r["community"] for r in state.collect()}
    q = [plain_q(near, {a: a for a in near})] + [plain_q(near, x) for x in course]
    assert all(b > a for a, b in zip(q, q[1:])) and course[-1] == label and set(label) == set(near)
    assert max(gains(near, label))[0] <= 0
    if graph is cliques:
        assert all(len({label[1000 * k + i] for i in range(4 + k)}) == 1 for k in range(10)) and len({label[1000 * k] for k in range(10)}) >= 5
    shares = C.quality(df, state.select("node", "community")).collect()
    m2 = sum(map(len, near.values()))
    assert abs(sum(r["share"] for r in shares) - plain_q(near, label) / m2**2) < 1e-4 and sum(r["inside"] * m2 - r["total"] ** 2 for r in shares) == q[-1]
    again = C.local_moving(df.repartition(7), sweeps=60)
    assert {r["node"]: r["community"] for r in again.collect()} == label


def test_best_moves_are_those_of_a_plain_version(spark):
    near = neighbours(random_graph())
    label = {a: a // 10 for a in near}
    both = spark.createDataFrame([(a, b) for a in near for b in near[a]], "src long, dst long")
    state = spark.createDataFrame([(a, len(near[a]), label[a]) for a in near], "node long, d long, community long")
    got = {r["node"]: (int(r["gain"]), r["target"]) for r in C.best_moves(both, state, both.count()).collect()}
    want = {}
    for g, a, c in gains(near, label):
        if g > 0 and (a not in want or (g, -c) > (want[a][0], -want[a][1])):
            want[a] = (g, c)
    assert got == want and want


def test_names_sizes_and_members(spark):
    state = cut(C.local_moving(spark.createDataFrame(cliques(), "src long, dst long"), sweeps=60))
    rows = C.named(state, 3, 12).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["community"]].append(r)
    assert len(rows) == state.count()
    for name, own in by.items():
        hub = max(own, key=lambda r: (r["degree"], -r["node"]))["node"]
        assert name == f"{hub}__n{len(own)}" and all(r["size"] == len(own) and r["kept"] == (3 <= len(own) <= 12) for r in own)
    found = C.members(C.named(state), spark.createDataFrame([(9000,), (90_000,), (-1,)], "node long"), 5).collect()
    assert {r["symbol"] for r in found} == {9000, 90_000} and all((r["node"] == r["symbol"]) == (r["place"] == 1) for r in found)
    assert sum(r["symbol"] == 9000 for r in found) == 5 and sum(r["symbol"] == 90_000 for r in found) == 2


def test_no_edges(spark):
    assert C.local_moving(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


def test_query_over_whole_tables(spark):
    out = {r["node"]: r["community"] for r in Q.QUERIES["communities"](spark, SF).collect()}
    near = neighbours((r["src"], r["dst"]) for r in Q.edges(spark, SF).collect())
    assert set(out) == set(near) and plain_q(near, out) > 0


@pytest.mark.parametrize("label", [lambda a: a, lambda a: a // 10, lambda a: 7])
def test_moves_by_groups_are_those_of_joins(spark, monkeypatch, label):
    """The nodes of a graph are dealt over many groups, each with its own arcs alone."""
    monkeypatch.setattr(C, "ARCS", 150)
    near = neighbours(random_graph() + cliques())
    both = cut(spark.createDataFrame([(a, b) for a in near for b in near[a]], "src long, dst long"))
    state = cut(spark.createDataFrame([(a, len(near[a]), label(a)) for a in near], "node long, d long, community long"))
    m2 = both.count()
    dealt = C._Dealt(both, m2)
    assert dealt.groups > 10 and dealt.packed.select("group").distinct().count() > 5
    got, want = ({tuple(map(int, r)) for r in df.select("node", "d", "origin", "target", "gain").collect()} for df in (dealt.best_moves(state, m2), C.best_moves(both, state, m2)))
    assert got == want and (want or label(1) == label(2))


def test_both_ways_give_the_same_communities(spark, monkeypatch):
    df = spark.createDataFrame(cliques(), "src int, dst int")
    want = {tuple(r) for r in C.local_moving(df, sweeps=4).collect()}
    monkeypatch.setattr(C, "LARGE", 0)
    assert {tuple(r) for r in C.local_moving(df, sweeps=4).collect()} == want
