"""The factorisation machine: its margins against all pairs written out, held-out accuracy, and defined cases."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmine.llm import quality

SF = "/root/testdata/sf0.01"


def test_margins_equal_all_pairs_written_out():
    rng = np.random.default_rng(4)
    m = quality.Machine(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    column = pa.array(["The cat. the CAT sat 12 on!! it", None, "", "x " * 500, "Ünï | wörd ###"])
    parts = list(quality.features(column, np.array([31.0, -1, 0, 1000, 15])))
    assert [(a, b) for a, b, *_ in parts] == [(0, 5)]
    _, _, rows, columns, values, stats = parts[0]
    rows, columns, values = m.with_figures(rows, columns, values, stats)
    z, _ = m.margins(rows, columns, values, 5)
    for r in range(5):
        c, x = columns[rows == r], values[rows == r]
        pairs = sum(x[i] * x[j] * (m.factors[c[i]] @ m.factors[c[j]]) for i in range(len(c)) for j in range(i))
        assert abs(z[r] - (0.3 + x @ m.linear[c] + pairs)) < 1e-8
        assert len(set(c.tolist())) == len(c)


def test_figures_of_plain_texts():
    (_, _, _, _, _, stats), *_ = quality.features(pa.array(["AB cd cd 12", "", "| |\n!"]), np.full(3, -1.0))
    assert np.allclose(stats[0, [2, 3, 10, 11, 12]], [2, 2 / 6, 3 / 4, 1 / 4, 0]) and np.allclose(stats[0, :2], np.log1p([11, 4]))
    assert (stats[1] == 0).all() and np.allclose(stats[2, [10, 11, 12, 13]], [2 / 3, 1 / 3, 1, 1 / 3])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out))
    unseen = out[out.held_out]
    assert (unseen.predicted == unseen.quality).mean() >= 0.97 and unseen.score.between(0, 1).all()


def test_labels_and_names_are_no_inputs(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "label": F.lit(1), "Score": F.lit("s"), "a.b": F.lit(0), "__id": F.lit(0)})
    b = {r["doc_id"]: r["score"] for r in quality.classify(other, labels.withColumn("extra", F.lit(1))).collect()}
    held = labels.where(quality.held_out(F.col("doc_id"))).withColumn("quality", 1 - F.col("quality"))
    c = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels.where(~quality.held_out(F.col("doc_id"))).unionByName(held)).collect()}
    assert a == b == c


def test_hard_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0), (6, 0), (7, None), (None, 1), (11, 0), (11, 1), (999, 0)], "doc_id long, quality int")
    docs = hard.union(hard.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = quality.classify(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and not out[out.doc_id.isna()].held_out.any()
    assert out[out.doc_id == 9].score.nunique() == 1
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(hard.drop("n_chars"), labels).count() == hard.count()
    assert set(quality.classify(hard, labels.where("quality = 1")).toPandas().predicted) == {1}
