"""Small hand-derived cases."""

from pyspark.sql import functions as F

from quillmine.functions import columns as C
from quillmine.operators import graph as G
from quillmine.operators import memory as M
from quillmine.operators import search as S
from quillmine.operators import sequence as Q


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rank_fusion_prefers_what_both_lists_hold(spark):
    make = lambda ids: spark.createDataFrame([(i, float(-k)) for k, i in enumerate(ids)], "id long, score double")
    out = S.rrf([make([1, 5, 6, 7, 8]), make([9, 1, 10, 11, 12])]).collect()
    assert (out[0]["id"], out[0]["score"]) == (1, round(1 / 61 + 1 / 62, 6))
    assert S.rrf([make([1, 2, 7, 3, 4]), make([9, 10, 7, 11, 12])]).first()["id"] == 7


def test_validity_thresholds(spark):
    log = spark.createDataFrame([(1, False)] * 4 + [(2, True)] + [(3, False)] * 2, "obs_id long, ok boolean")
    assert {r["obs_id"]: r["state"] for r in M.validity(log).collect()} == {1: "quarantine", 2: "valid", 3: "stale-suspected"}


def test_graph_shapes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (5, 6), (6, 7), (7, 5), (8, 8), (3, 9)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {r["node"]: r["depth"] for r in G.bfs(e, seed).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 9: 3}
    assert rows(G.call_chain(e, seed, 9)) == [(0, 1), (1, 2), (2, 3), (3, 9)]
    assert rows(G.cycles(e)) == [(5, 5), (6, 5), (7, 5)]
    assert rows(G.components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5), (8, 8), (9, 1)]


def test_jaccard_pairs_at_the_threshold(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g x y z"), (3, "a b c d e f g h i k"), (4, ""), (5, None)], "id long, title string")
    assert rows(M.title_pairs(d, 0.8)) == [(1, 3, round(9 / 11, 6))]


def test_beam_and_npmi(spark):
    calls = spark.createDataFrame([(1, k, s) for k, s in enumerate("abcabcabd")], "session long, ord long, state string")
    assert Q.beam(calls, "a").first()["path"].startswith("b>c")
    act = spark.createDataFrame([(s, x) for s in (1, 2, 3) for x in ("foo", "bar")], "session long, symbol string")
    assert Q.npmi(act).first()["npmi"] == 1.0


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(C.entropy(F.lit("aabb"))) == 1.0 and value(C.entropy(F.lit(""))) == 0.0
    assert value(C.content_hash(F.lit("  \n"))) is None
    assert value(C.strip_private(F.lit("x <private>a\nb</private> y"))) == "x [PRIVATE] y"
    assert value(C.preview(F.lit("short"))) == "short"
    assert value(C.fts_query(F.lit("the quick fox"))) == '"quick" OR "fox"'
