"""Deltas give back every title; lengths, abstractions and links against a plain version."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmine.operators import distillation as D

TITLES = [f"never commit secrets to the repository variant {k}" for k in range(5)] + ["never  commit @secrets \\to the repository", "lone title", "", None, "short", "short", "short"]
KINDS = ["guardrail"] * 6 + ["note", "note", "note", None, None, "note"]
MORE = [(100 + k, "bug", f"@{k} crash in parser line {k} \\x") for k in range(4)] + [(200 + k, "other", f"never commit secrets to the repository variant {k}") for k in range(2)] + [(None, "bug", "crash in parser line")]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, k, t) for i, (k, t) in enumerate(zip(KINDS, TITLES))] + MORE
    return spark.createDataFrame([(*r, "x") for r in data], "id long, kind string, title string, cluster string").drop("cluster").repartition(3)


def plain_clusters(rows):
    data = [(r["id"], r["kind"] or "note", set((r["title"] or "").lower().split())) for r in rows.collect() if r["id"] is not None]
    root = {i: i for i, _, w in data if w}
    for _ in data:
        for i, k, w in data:
            for j, m, v in data:
                if k == m and w and v and len(w & v) / len(w | v) >= D.JACCARD:
                    root[i] = root[j] = min(root[i], root[j])
    size = Counter(root.values())
    return {i: r for i, r in root.items() if size[r] >= D.MEMBERS}


def test_clusters_within_kinds(rows):
    assert {r["id"]: r["cluster"] for r in D.clusters(rows).collect()} == plain_clusters(rows)


def test_deltas_and_lengths(rows):
    found = D.clusters(rows)
    out = D.distilled(rows, found).withColumn("again", D.restored(F.col("delta"), F.col("pieces"))).collect()
    titles = {r["id"]: r["title"] for r in rows.collect()}
    assert len(out) == found.count() and all(r["again"] == r["title"] == titles[r["id"]] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["cluster"], []).append(r)
    kinds = {r["id"]: r["kind"] or "note" for r in rows.collect()}
    for cluster, own in by.items():
        count = Counter(p for r in own for p in set(r["title"].split(" ")) if len(p) > 2)
        pieces = sorted((p for p, n in count.items() if n >= len(own) * D.SHARED), key=lambda p: (-count[p], p))[: D.MOST]
        assert all(r["pieces"] == pieces and r["members"] == len(own) and r["before"] == sum(len(x["title"]) for x in own) for r in own)
        abstraction = f"[MDL:{kinds[cluster]}] " + " ".join(pieces)
        assert all(r["abstraction"] == abstraction and r["after"] == len(abstraction) + sum(len(x["delta"]) for x in own) for r in own)
    chosen = D.accepted(D.distilled(rows, found)).collect()
    good = {c for c, own in by.items() if (own[0]["before"] - own[0]["after"]) / own[0]["before"] >= D.LEAST}
    assert {r["cluster"] for r in chosen} == good and 0 in good and len(good) < len(by)


def test_applied(rows):
    chosen = D.accepted(D.distilled(rows, D.clusters(rows)))
    kept, links = D.applied(rows, chosen)
    ids = {r["id"] for r in chosen.collect()}
    assert {(r["target"], r["link_type"]) for r in links.collect()} == {(i, "supersedes") for i in ids}
    after = kept.collect()
    assert len(after) == rows.count() + len({r["source"] for r in links.collect()})
    assert {r["id"] for r in after if (r["title"] or "").startswith("[delta] ")} == ids
    assert {r["id"] for r in after if r["id"] is not None and r["id"] < 0} == {r["source"] for r in links.collect()}


def test_nothing(rows):
    assert D.accepted(D.distilled(rows.limit(0), D.clusters(rows.limit(0)))).count() == 0
