"""The kept vector index: exact search equals comparing all, probing reaches its recall, and only changed rows are assigned again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.operators import vector_index as V
from quillmine.plans import vector_queries as Q


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, embedding array<double>")


def plain(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    u = V.unit(np.array([v for _, v in rows], float))
    out = set()
    for q, v in asked:
        d = np.linalg.norm(u - V.unit(np.array([v], float)), axis=1)
        score = np.round(np.maximum(0, 1 - d * d / 2), 6)
        out |= {(q, int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score))[:k]}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 16))
    return [(i, middle[i % 12 if i % 4 else 0] + rng.normal(size=16) * 0.3) for i in range(900)]  # one list holds a third


@pytest.mark.parametrize("probes", [1, 5])
def test_exact_search_equals_comparing_all(spark, tmp_path, clustered, monkeypatch, probes):
    monkeypatch.setattr(V, "PACK", 50)
    index = V.VectorIndex(spark, f"file://{tmp_path}/v", lists=16)
    index.sync(frame(spark, clustered).repartition(3))
    asked = [(i, v) for i, v in clustered if i % 50 == 0]
    queries = frame(spark, asked).withColumnRenamed("id", "query")
    want = plain(clustered, asked, 7)
    got = {tuple(r) for r in index.search(queries, 7, probes).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and sum(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want))) < 1e-4
    near = {tuple(r)[:2] for r in index.search(queries, 7, probes, exact=False).collect()}
    assert len(near & {w[:2] for w in want}) >= (0.9 if probes > 1 else 0.5) * len(want)


def test_the_bound_leaves_lists_unread(spark, tmp_path, clustered):
    index = V.VectorIndex(spark, f"file://{tmp_path}/v", lists=12)
    index.sync(frame(spark, clustered))
    queries = frame(spark, clustered[:20]).withColumnRenamed("id", "query").withColumn("d", F.lit(0.2))
    radius = np.zeros(len(index.centres))
    for r in index.rows().groupBy("list").agg(F.max("dist").alias("r")).collect():
        radius[r["list"]] = r["r"]
    assert index._near(queries, radius, 1, True).count() < 0.5 * 20 * (len(index.centres) - 1)


def test_recall_of_probing_over_whole_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    exact = {tuple(r)[:2] for r in Q.QUERIES["semantic_search"](spark, sf).collect()}
    probed = {tuple(r)[:2] for r in Q.QUERIES["semantic_search_probing"](spark, sf).collect()}
    assert len(exact & probed) >= 0.9 * len(exact)


def test_sync_assigns_only_what_changed(spark, tmp_path, clustered, monkeypatch):
    index = V.VectorIndex(spark, f"file://{tmp_path}/v", lists=8)
    now = dict(clustered[:300])
    assert index.sync(frame(spark, now.items())) == {"unchanged": 0, "indexed": 300, "pruned": 0}
    del now[3], now[4]
    now[5], now[1000] = -now[5], now[6]
    before = {r["id"]: r["list"] for r in index.rows().collect()}
    assert index.sync(frame(spark, now.items())) == {"unchanged": 297, "indexed": 2, "pruned": 2}
    assert spark.read.parquet(f"file://{tmp_path}/v/rows/seg=2").count() == 2
    rows = index.rows().collect()
    assert {r["id"] for r in rows} == set(now) and all(r["list"] == before[r["id"]] for r in rows if r["id"] not in (5, 1000))
    assert index.sync(frame(spark, now.items())) == {"unchanged": 299, "indexed": 0, "pruned": 0} and index.segments == [1, 2]
    asked = [(7, now[7]), (5, now[5])]
    got = {tuple(r)[:2] for r in index.search(frame(spark, asked).withColumnRenamed("id", "query"), 5, 1).collect()}
    assert got == {w[:2] for w in plain(list(now.items()), asked, 5)}


def test_hard_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, []), (1, [1.0, 0.0]), (6, [2.0, 0.0])]
    index = V.VectorIndex(spark, f"file://{tmp_path}/v")
    assert index.search(frame(spark, rows).withColumnRenamed("id", "query"), 3, 2).count() == 0
    assert index.sync(frame(spark, rows))["indexed"] == 3
    got = sorted(map(tuple, index.search(frame(spark, [(9, [3.0, 0.0]), (8, None), (7, [1.0])]).withColumnRenamed("id", "query"), 5, 1).collect()))
    assert got == [(9, 1, 1.0), (9, 3, 0.5), (9, 6, 1.0)]
    assert V.VectorIndex(spark, f"file://{tmp_path}/e").sync(frame(spark, [(1, None)])) == {"unchanged": 0, "indexed": 0, "pruned": 0}


def test_a_pair_of_full_blocks_holds_few_distances(monkeypatch):
    """Two blocks of PACK rows give the k nearest of a plain sort, ties by id, in less memory than all distances take."""
    import tracemalloc

    rng = np.random.default_rng(9)
    ids, asked = rng.permutation(V.PACK) + 7, np.arange(V.PACK)
    v, q = V.unit(rng.integers(-1, 2, (V.PACK, 4)).astype(float)), V.unit(rng.integers(-1, 2, (V.PACK, 4)).astype(float))  # many ties
    tracemalloc.start()
    got = [np.concatenate(x) for x in zip(*V.nearest(asked, q, ids, v, 5))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = V.distances(q, v)
    order = np.lexsort((np.broadcast_to(ids, far.shape), np.round(far, 9)), axis=1)[:, :5]
    assert (got[0] == np.repeat(asked, 5)).all() and (got[1] == ids[order].ravel()).all() and np.allclose(got[2], np.take_along_axis(far, order, 1).ravel(), atol=1e-9)
    assert peak < V.PACK**2 * 8
    assert [len(x) for x in next(V.nearest(asked[:1], q[:1], ids[:3], v[:3], 5))] == [3, 3, 3]


def test_partitions_do_not_send_a_whole_sample_each_to_the_driver(spark, tmp_path, monkeypatch):
    def sent():
        gateway = spark.sparkContext._gateway
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum({s.stageId(): s.resultSize() for s in map(stages.apply, range(stages.size()))}.values())

    monkeypatch.setattr(V, "SAMPLE", 500)
    rng = np.random.default_rng(2)
    rows = {i: rng.normal(size=16 if i % 40 else 3) for i in range(10_000)}
    path = f"file://{tmp_path}/rows"
    frame(spark, rows.items()).repartition(20).write.parquet(path)
    df, seen = spark.read.option("mergeSchema", False).parquet(path).repartition(20), []
    monkeypatch.setattr(V, "fit_centres", lambda sample, lists: seen.append(sample))
    index, before = V.VectorIndex(spark, f"file://{tmp_path}/v"), sent()
    index._fit(df)
    import hashlib

    least = sorted(rows, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:500]
    assert np.array_equal(seen[0], V.unit(np.array([rows[i] for i in least if len(rows[i]) == 16])))
    assert sent() - before < 1_000_000


def test_only_replaced_ids_are_kept_as_gone(spark, tmp_path, clustered):
    index = V.VectorIndex(spark, f"file://{tmp_path}/v", lists=8)
    now = dict(clustered[:60])
    index.sync(frame(spark, now.items()))
    assert spark.read.parquet(f"file://{tmp_path}/v/gone/seg=1").count() == 0
    first = now.pop(3)
    now[5], now[2000] = -now[5], now[6]
    index.sync(frame(spark, now.items()))
    assert {r["id"] for r in spark.read.parquet(f"file://{tmp_path}/v/gone/seg=2").collect()} == {3, 5}
    index.sync(frame(spark, {**now, 3: first}.items()))
    assert sorted(r["id"] for r in index.rows().collect()) == sorted([*now, 3])


def test_blocks_are_not_broadcast(spark, tmp_path, clustered):
    index = V.VectorIndex(spark, f"file://{tmp_path}/v", lists=8)
    index.sync(frame(spark, clustered[:100]))
    near = index._near(frame(spark, clustered[:20]).withColumnRenamed("id", "query"), np.zeros(1), 4, False)
    found = index._compared(near, 3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the one join of blocks, which stands before the joins with replaced ids
    assert "SortMergeJoin [list" in plan and "BroadcastHashJoin [list" not in plan
