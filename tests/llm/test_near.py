"""The near-duplicate stage against all pairs."""

import random

import numpy as np

from pyspark.sql import functions as F
from quillmine.llm import near, simhash


def brute(rows, threshold=0.8):
    sets = {}
    for k, text in rows:
        w = (text or "").lower().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def corpus():
    r = random.Random(7)
    word = lambda: f"w{r.randrange(4000)}"
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "One two")]
    common = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(r.randrange(40, 160))] + (common if r.random() < 0.5 else [])
        for _ in range(r.randrange(1, 30)):
            own = list(base)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    return rows


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for crowd in (2, 16):
        assert {r["doc_id"]: r["component_id"] for r in near.classes(docs, crowd=crowd).collect()} == want
    monkeypatch.setattr(near, "EVERY", 1)
    for salt, size, values in ((4, 3, 900),):
        for name, value in (("SALT", salt), ("ROWS", size), ("VALUES", values)):
            monkeypatch.setattr(near, name, value)
        assert {r["doc_id"]: r["component_id"] for r in near.classes(docs, crowd=2).collect()} == want
    kept = near.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_compare_in_small_steps():
    r = random.Random(3)
    base = [np.array(sorted(r.sample(range(300), 60))) for _ in range(5)]
    sets = []
    for k in range(40):
        own = set(base[k % 5].tolist())
        for x in r.sample(sorted(own), k % 7):
            own.discard(x)
        sets.append(np.array(sorted(own), np.int32))
    sets[7] = np.zeros(0, np.int32)
    roots = np.array([k // 2 for k in range(40)])
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if roots[i] != roots[j] and similar(set(sets[i].tolist()), set(sets[j].tolist()))}
    for left in (0, 1, 13, 40):
        assert set(zip(*(x.tolist() for x in near._compare(sets, roots, 0.8, 1000, left)))) == {x for x in want if x[0] < left}
    for most in (10, 1000, 4 << 20):
        assert set(zip(*(x.tolist() for x in near._compare(sets, roots, 0.8, most)))) == want


def test_bitmaps_tell_apart_only_what_is():
    r = random.Random(5)
    for size in (0, 1, 40, 900, 1100, 2040, 2060, 5000):
        for change in (0, size // 20, size // 9, size // 7, size // 3):
            a = {r.getrandbits(64) for _ in range(size)}
            b = set(r.sample(sorted(a), size - change)) | {r.getrandbits(64) for _ in range(r.randrange(change + 1))}
            both = [np.array(sorted(x), np.uint64) for x in (a, b)]
            bits, n = [near.bitmap(x) for x in both], np.array([len(x) for x in both])
            apart = near._apart(bits, np.array([0]), np.array([1]))[0]
            assert apart <= len(a ^ b) and (len(a ^ b) - apart) % 2 == 0
            if len(a & b) >= 0.8 * len(a | b):
                assert near._possible(n, bits, np.array([0]), np.array([1]), 0.8)[0]
    unlike = [np.unique(np.array([r.getrandbits(64) for _ in range(600)], np.uint64)) for _ in range(2)]
    assert not near._possible(np.array([600, 600]), [near.bitmap(x) for x in unlike], np.array([0]), np.array([1]), 0.8)[0]


def test_texts_reach_python_in_batches_of_bounded_bytes(spark, monkeypatch, tmp_path):
    """Rows of 4,000 bytes came 10,000 at once, and workers kept what such batches took."""
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.substring(F.sha2(F.concat_ws("-", F.col("id") % 5997, k), 256), 1, 9))).alias("text"))
    for module, name in ((near, "shingle_sets"), (simhash, "texts")):
        plain, folder = getattr(module, name), tmp_path / name
        folder.mkdir()

        def seen(column, plain=plain, folder=str(folder)):
            import uuid

            open(f"{folder}/{column.nbytes}-{uuid.uuid4().hex}", "w").close()
            return plain(column)

        monkeypatch.setattr(module, name, seen)
    got = {r["doc_id"]: r["component_id"] for r in near.joint_classes(docs).collect()}
    assert got == {k: k % 5997 for k in range(6000)}
    for name in ("shingle_sets", "texts"):
        sizes = [int(p.name.split("-")[0]) for p in (tmp_path / name).iterdir()]
        assert sum(sizes) >= 20 << 20 and max(sizes) < 6 << 20


def test_hot_shingles_need_no_python(spark):
    rows = spark.createDataFrame([(7, 3, [1, 2]), (8, 2, [2])], "node long, n int, shingles array<long>")
    keys = near._keys(rows, [(2, 5)])
    assert keys._jdf.queryExecution().toString().count("ExistingRDD") == near._keys(rows, [])._jdf.queryExecution().toString().count("ExistingRDD") * 2
    assert sorted((r["shingle"], r["salt"] >= 0, r["node"], r["n"]) for r in keys.collect()) == [(1, False, 7, 3), (2, True, 7, 3), (2, True, 8, 2)]
