"""The pipeline's stages keep the columns, each works on what the one before kept, and each is held against a plain version."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quillmine.llm import mixing, toxicity
from tests.llm.test_llm_operators import plain_fingerprint, plain_roots
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"
SECRET = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|(?-i:AKIA[A-Z0-9]{14,}|[0-9a-f]{16,})""", re.I)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.park(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert docs.where("text RLIKE 'AKIA[A-Z0-9]{14,}'").isEmpty()
    assert set(columns) < set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)


def test_stages_on_hard_rows(spark, hard, nothing):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage; so does an empty table."""
    extra = hard.selectExpr(*[("CAST(NULL AS BIGINT) AS doc_id" if c == "doc_id" else c) for c in hard.columns]).limit(2)
    docs = hard.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, nothing):
            out = stage(spark, table, SF)
            assert set(table.columns) <= set(out.columns) and (out.count() == 0) == (table is nothing)


CLASHES = ["label", "Score", "a.b", "__id", "__text", "__gone", "__bad", "__blob", "__spans", "__rate", "__n", "__source", "rest", "size", "node", "fp", "seed", "hash", "quality", "item_id", "x`y"]


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_pass_through(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    run = dict(corpus_pipeline.STAGES)[stage]
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    want, got = run(spark, docs, SF), run(spark, more, SF)
    added = [c for c in want.columns if c not in docs.columns]
    assert got.columns == more.columns + added
    rows = got.collect()
    assert all(r[c] == k for r in rows for k, c in enumerate(CLASHES))
    assert sorted(map(str, want.collect())) == sorted(str(r) for r in got.select(*docs.columns, *added).collect())


def test_toxicity_query_with_any_further_column(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    assert {r["doc_id"]: r["predicted"] for r in toxicity.classify(more, labels).collect()} == {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).collect()}


def test_toxicity_drops_what_scores_high(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.classify(docs, labels).collect()
    kept = [r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in scored if r["predicted"] == 0) and len(kept) < len(scored)


def python_bytes(df):
    """Bytes that the last run of df sent to Python workers, and that came back."""
    sent, back, plans = 0, 0, [df._jdf.queryExecution().executedPlan()]
    for plan in plans:
        metrics = plan.metrics()
        sent, back = (n + (metrics.apply(k).value() if metrics.contains(k) else 0) for n, k in ((sent, "pythonDataSent"), (back, "pythonDataReceived")))
        plans += [plan.children().apply(k) for k in range(plan.children().size())]
    return sent, back


def test_toxicity_sends_each_text_to_python_once_and_gets_scores_only(spark):
    """Rows that went there and back, the text twice, took executors' memory that grew with all columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("more", F.repeat("text", 3))
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    n = len(kept.collect())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sent, back = python_bytes(kept)
    assert n and size < sent < 1.1 * size + 100_000 and 0 < back < 0.1 * size + 10_000


def test_toxicity_passes_hold_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    texts = pa.array([f"word {k} and others, {k * k} in all " * 20 for k in range(2000)])
    tracemalloc.start()
    toxicity.Model(weights, 0.0).scores(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20


def test_near_duplicates_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bits = {i: plain_fingerprint(t) for i, t in rows.items()}
    roots = plain_roots(sorted(set(bits.values())), 2)
    similar = brute([(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for i, t in rows.items()])
    root = {i: i for i in rows}
    while True:
        least = {}
        for i, r in root.items():
            for name in (("bits", roots[bits[i]]), ("sets", similar[i])):
                least[name] = min(r, least.get(name, r))
        new = {i: min(least["bits", roots[bits[i]]], least["sets", similar[i]]) for i in root}
        if new == root:
            break
        root = new
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == sorted(set(root.values()))


def test_decontamination_and_secrets_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for r in docs.collect():
        words = re.findall(r"[^\W_]+", (r["text"] or "").lower())
        at = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        bad = False
        for item in items:
            m = min(len(item), 13)
            equal = {}
            for k, w in enumerate(item):
                for p in at.get(w, ()):
                    equal.setdefault(p - k, set()).add(k)
            bad |= any(len(s) >= 0.8 * m and max(sum(k in s for k in range(a, a + m)) for a in range(len(item) - m + 1)) >= 0.8 * m for s in equal.values())
        if not bad:
            clean.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()) == sorted(clean)
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_secrets(spark, docs, SF).collect()}
    for r in docs.collect():
        assert SECRET.search(masked[r["doc_id"]] or "") is None
        assert SECRET.search(r["text"] or "") or masked[r["doc_id"]] == r["text"]


def test_mixing_repeats_rows_as_the_sizes_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_sizes(docs).collect()}
    copies = {r["doc_id"]: r["count"] for r in corpus_pipeline.mix_sources(spark, docs, SF).groupBy("doc_id").count().collect()}
    assert all(copies.get(i, 0) * size == words for i, (size, words) in taken.items())
