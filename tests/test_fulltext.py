"""The kept index after batches of changes equals one built anew; searches read their terms' partitions; excerpts and phrases against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmine.operators import fulltext as X
from quillmine.operators import search as S

WORDS = [f"w{k:02d}" for k in range(30)] + ["The", "THE", "été", "a_b", "ab"]


def plain_words(text):
    return re.findall("[A-Za-z0-9_]{3,}", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def table(index):
    return sorted((r["term"], r["id"], r["dl"], tuple(r["positions"])) for r in index.postings().collect())


def wanted(now):
    out = []
    for i, text in now.items():
        w = plain_words(text)
        out += [(t, i, len(w), tuple(k for k, x in enumerate(w) if x == t)) for t in set(w)]
    return sorted(out)


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index after many batches, with the documents that it must hold."""
    rng = random.Random(3)
    path = f"file://{tmp_path_factory.mktemp('index')}/fts"
    now, seen = {}, []
    fanout, X.FANOUT = X.FANOUT, 4
    try:
        for step in range(7):
            ups = {rng.randrange(60): rng.choice([None, "", "x y", " ".join(rng.choices(WORDS, k=rng.randrange(1, 40)))]) for _ in range(15)}
            downs = [rng.randrange(80) for _ in range(5)]
            for i in downs:
                now.pop(i, None)
            now |= ups
            rows = [*ups.items(), (None, "w01 w02")]
            index = X.FullText(spark, path)  # opened anew each time
            index.apply(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(i,) for i in [*downs, None]], "id long"))
            m = index.manifest()
            assert m["docs"] == len(now) and m["tokens"] == sum(len(plain_words(t)) for t in now.values())
            seen.append(len(m["segments"]))
    finally:
        X.FANOUT = fanout
    assert max(seen) == 4 and 1 in seen[1:]  # it grew and was merged
    return X.FullText(spark, path), now


def test_index_after_batches_equals_one_built_anew(spark, grown, tmp_path):
    index, now = grown
    assert len(index.manifest()["segments"]) > 1 and table(index) == wanted(now)
    fresh = X.FullText(spark, f"file://{tmp_path}/fts")
    fresh.apply(spark.createDataFrame(list(now.items()), "id long, text string"))
    assert table(fresh) == table(index)
    assert {k: index.manifest()[k] for k in ("docs", "tokens")} == {k: fresh.manifest()[k] for k in ("docs", "tokens")}
    assert sorted(r["id"] for r in index.lengths().collect()) == sorted(now)


def test_bm25_equals_the_search_without_an_index(spark, grown):
    index, now = grown
    queries = spark.createDataFrame([(1, "w01 w02 the w01"), (2, "w29"), (3, ""), (4, "unknown words"), (5, None)], "query long, text string")
    docs = spark.createDataFrame(list(now.items()), "id long, text string")
    got = sorted((r["query"], r["place"], r["id"], r["score"]) for r in index.search(queries, 7).collect())
    want = sorted((r["query"], r["place"], r["id"], r["score"]) for r in S.bm25_each(docs, queries, 7).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, want)) and {g[0] for g in got} == {1, 2}


def test_phrases_against_plain_search(spark, grown):
    index, now = grown
    asked = [(1, "w01"), (2, "the the"), (3, "w05 w06"), (4, ""), (5, "w03 ab W07 !")] + [(10 + k, " ".join(plain_words(t)[2 : 2 + k])) for k in (2, 3) for t in now.values() if len(plain_words(t)) > 6]
    asked = list({q: t for q, t in asked}.items())
    got = {(r["query"], r["id"]): (r["first"], r["hits"]) for r in index.phrase(spark.createDataFrame(asked, "query long, text string")).collect()}
    want = {}
    for q, text in asked:
        p = plain_words(text)
        for i, t in now.items():
            w = plain_words(t)
            at = [k for k in range(len(w) - len(p) + 1) if p and w[k : k + len(p)] == p]
            if at:
                want[q, i] = (at[0], len(at))
    assert got == want and len(got) > 10


def test_a_search_reads_only_its_terms_partitions(spark, grown, tmp_path):
    fresh = X.FullText(spark, f"file://{tmp_path}/fts")
    fresh.apply(spark.createDataFrame(list(grown[1].items()), "id long, text string"))
    queries = spark.createDataFrame([(1, "w01"), (2, "w02 w01")], "query long, text string")
    parts = {r["p"] for r in queries.select(F.explode(X.words(F.col("text"))).alias("t")).select(X.part_of(F.col("t")).alias("p")).collect()}
    touched = lambda rows: {int(re.search(r"/part=(\d+)/", r["f"])[1]) for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert touched(fresh._terms(queries)[1]) == parts and len(touched(fresh.postings())) > len(parts)
    for index in (fresh, grown[0]):
        plan = index._terms(queries)[1]._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\n]*part#\d+ IN \([^)]*\)", plan)


def test_a_batch_that_dies_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/fts"
    index = X.FullText(spark, path)
    index.apply(spark.createDataFrame([(1, "one two three")], "id long, text string"))
    before = table(index)
    monkeypatch.setattr(X.FullText, "_publish", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.apply(spark.createDataFrame([(1, "other"), (2, "four")], "id long, text string"))
    monkeypatch.undo()
    assert table(X.FullText(spark, path)) == before
    X.FullText(spark, path).apply(spark.createDataFrame([(2, "four")], "id long, text string"))
    assert {r[1] for r in table(X.FullText(spark, path))} == {1, 2}


def plain_snippet(text, terms, first, width):
    found = list(re.finditer("[A-Za-z0-9_]{3,}", text))
    start = max(0, min(first - width // 4, len(found) - width))
    end = min(len(found), start + width)
    out, last = "", None
    for m in found[start:end]:
        out += text[last : m.start()] if last is not None else ""
        out += f"»{m[0]}«" if m[0].lower() in terms else m[0]
        last = m.end()
    return ("..." if start else "") + out + ("..." if end < len(found) else "")


@pytest.mark.parametrize("width", [1, 4, 40])
def test_snippets(spark, width):
    data = [("Alpha, beta — GAMMA!\ndelta alpha end", ["alpha", "gamma"], 0), ("Alpha, beta — GAMMA!\ndelta alpha end", ["end"], 5), ("one", ["one"], 0), (" .. lone-word ?", ["word"], 1), ("é" * 50 + " abc " * 60, ["abc"], 30)]
    rows = spark.createDataFrame(data, "text string, terms array<string>, first int").select("*", X.snippet(F.col("text"), F.col("terms"), F.col("first"), width).alias("s")).collect()
    assert [r["s"] for r in rows] == [plain_snippet(t, set(q), f, width) for t, q, f in data]


def test_empty_index(spark, tmp_path):
    index = X.FullText(spark, f"file://{tmp_path}/fts")
    queries = spark.createDataFrame([(1, "abc")], "query long, text string")
    assert index.search(queries, 5).count() == 0 and index.phrase(queries).count() == 0 and index.manifest()["docs"] == 0
    index.apply(deletes=spark.createDataFrame([(1,)], "id long"))
    index.merge()
    assert index.search(queries, 5).count() == 0


def test_texts_are_not_exchanged_nor_places_by_query(spark, exchanged, tmp_path):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice(["the", f"x{rng.randrange(10**9)}"]) for _ in range(1000))) for i in range(60)]
    index = X.FullText(spark, f"file://{tmp_path}/fts")
    before = exchanged()
    index.apply(spark.createDataFrame(data, "id long, text string"))
    index.apply(spark.createDataFrame(data[:30], "id long, text string"))
    assert exchanged()[0] - before[0] < sum(len(t) for _, t in data) / 10
    queries = [(i, " ".join(plain_words(t)[k : k + 2])) for i, t in data for k in range(5)]
    queries = spark.createDataFrame([(n, q) for n, (_, q) in enumerate(queries)], "query long, text string")
    before = exchanged()
    assert index.phrase(queries).where("hits > 0").select("query").distinct().count() == 300
    assert exchanged()[1] - before[1] < 300_000  # 300 queries, most with a word that stands in 30,000 places


@pytest.mark.parametrize("size", [1, 3, 7, 1 << 21])
def test_blocks_of_any_size_hold_the_same_postings(monkeypatch, size):
    import pyarrow as pa

    rng = random.Random(size)
    monkeypatch.setattr(X, "BLOCK", size)
    docs = [(i * 3 - 20, rng.choices("abcd", k=rng.randrange(6))) for i in range(40)]
    batch = pa.record_batch({"id": pa.array([i for i, _ in docs]), "t": pa.array([t for _, t in docs], pa.list_(pa.string()))})
    got = []
    for part in X._blocks_of_texts([batch.slice(5, 20), batch.slice(0, 5), batch.slice(25)]):
        for r in part.to_pylist():
            for k, end in enumerate(r["ends"]):
                got.append((r["term"], r["ids"][k], r["dls"][k], tuple(r["places"][r["ends"][k - 1] if k else 0 : end])))
    assert sorted(got) == sorted((w, i, len(t), tuple(k for k, x in enumerate(t) if x == w)) for i, t in docs for w in set(t))
