"""The graph of whole tables against a plain version."""

import json

import pandas as pd

from quillmine.plans import graph_queries as Q

SF = "/root/testdata/sf0.001"


def plain():
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    seen = {}
    for _, user in e.groupby("user_id"):
        k = [json.loads(p)["k"] if p else None for p in user["props"]]
        for a, b in zip(k, k[1:]):
            if a is not None and b is not None:
                seen[int(a), int(b)] = seen.get((int(a), int(b)), 0) + 1
    li = pd.read_parquet(f"{SF}/lineitem.parquet")
    return {(3 * a, 3 * b) for (a, b), n in seen.items() if n >= Q.THETA} | {(3 * a + 1, 3 * b + 2) for a, b in zip(li["l_suppkey"], li["l_partkey"])}


def test_graph_of_tables(spark):
    want = plain()
    assert sorted(map(tuple, Q.QUERIES["reverse_graph"](spark, SF).collect())) == sorted((b, a) for a, b in want)
    nodes = {x for e in want for x in e}
    near = {x: set() for x in nodes}
    for a, b in want:
        near[a].add(b), near[b].add(a)
    label = {}
    for x in sorted(nodes):
        stack = [x] if x not in label else []
        while stack:
            y = stack.pop()
            if y not in label:
                label[y] = x
                stack += near[y]
    assert {r["node"]: r["component"] for r in Q.QUERIES["graph_components"](spark, SF).collect()} == label
    impact = {r["node"]: r["depth"] for r in Q.QUERIES["change_impact"](spark, SF).collect()}
    assert impact == {a: 1 for a, b in want if b == 5}
