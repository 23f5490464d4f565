"""Rows of equal titles in links and clusters, against all pairs."""

from quillmine.operators import memory as M
from quillmine.operators import store as W

TITLES = ["a b c d", "D c b a", "a b c d e", "x y", "y x", "Y X x", "lone", "", None, "p q r s t", "p q r s u"]


def test_every_row_has_its_links_and_its_cluster(spark):
    rows = list(enumerate(TITLES))
    sets = {k: frozenset((t or "").lower().split()) for k, t in rows}
    like = lambda a, b, least: bool(sets[a]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    d = spark.createDataFrame(rows, "id long, title string")
    got = {r["id"]: (r["representative"], r["n"], r["links"]) for r in M.title_links(d).collect()}
    assert {k: v[2] for k, v in got.items()} == {a: sum(like(a, b, 0.7) for b in sets if b != a) for a in sets}
    assert got[5] == (3, 3, 2) and got[7] == (7, 1, 0)
    assert {r["id"]: r["cluster"] for r in W.title_clusters(d, 0.7, 3).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert {r["id"]: r["cluster"] for r in W.title_clusters(d, 0.6, 2).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 9: 9, 10: 9}


def test_pairs_come_once_without_being_made_distinct(spark):
    rows = [(k, f"common words of title {k % 7} part {k % 3} and {k}") for k in range(60)]
    d = spark.createDataFrame(rows, "id long, title string").repartition(3)
    sets = {k: set(t.split()) for k, t in rows}
    found = M.title_pairs(d, 0.7)
    got = [(r["a"], r["b"], r["similarity"]) for r in found.collect()]
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sorted(got) == sorted((a, b, round(v, 6)) for (a, b), v in like.items() if v >= 0.7) and got
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
