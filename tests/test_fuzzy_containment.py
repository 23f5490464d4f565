"""Close pairs against difflib over all pairs; names in lines against plain containment."""

import difflib
import random
from collections import Counter

import pytest

from quillmine.operators import containment as C
from quillmine.operators import fuzzy as Z
from quillmine.plans import fuzzy_queries as Q

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def made(seed, n, alphabet="abcd_é", most=14):
    rng = random.Random(seed)
    out = {"".join(rng.choices(alphabet, k=rng.randrange(1, most))) for _ in range(n)}
    for w in rng.sample(sorted(out), n // 5):
        k = rng.randrange(len(w) + 1)
        out.add(w[:k] + rng.choice(alphabet) + w[k:])
    return sorted(out)


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string").repartition(3)


def test_blocks_are_those_of_the_standard_matcher():
    rng = random.Random(1)
    for most, alphabet in ((12, "ab"), (60, "abcdef"), (420, "abcdefghij")):
        for _ in range(120):
            a, b = ("".join(rng.choices(alphabet, k=rng.randrange(0, most))) for _ in range(2))
            if rng.random() < 0.5:
                b = a[: len(a) // 2] + b
            if a or b:
                assert 2.0 * Z.matched(a, b) / (len(a) + len(b)) == ratio(a, b)


@pytest.mark.parametrize("threshold", [0.35, 0.6, 2 / 3, 0.7, 0.75, 0.8, 0.95, 1.0])
@pytest.mark.parametrize("hot", [3, Z.HOT])
def test_pairs_equal_all_pairs(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(Z, "HOT", hot)
    names = made(2, 90)
    got = {(r["a"], r["b"]): r["ratio"] for r in Z.close_pairs(frame(spark, [*names, *names[:5], "", None]), None, threshold).collect()}
    assert got == {(a, b): ratio(a, b) for a in names for b in names if a < b and ratio(a, b) >= threshold}


def test_two_sides_keep_their_order_and_no_pair_comes_twice(spark):
    left, right = made(3, 80), made(4, 60) + ["x" * 210, "xy" * 105]
    left += right[:6] + ["x" * 205, "😀a😀b"]
    rows = [(r["a"], r["b"], r["ratio"]) for r in Z.close_pairs(frame(spark, left), frame(spark, right), 0.72).collect()]
    assert sorted(rows) == sorted((a, b, ratio(a, b)) for a in set(left) for b in set(right) if ratio(a, b) >= 0.72)


def test_close_matches_and_resolution(spark):
    words, possible = ["getuser", "parse_fle", "zzz"], ["get_user", "get_users", "set_user", "parse_file", "parse_files", "getuser"]
    got = Z.close_matches(frame(spark, words), frame(spark, possible), 3, 0.6)
    want = {w: [m for m in difflib.get_close_matches(w, [p for p in possible if p != w], 3, 0.6)] for w in words}
    found = {w: [] for w in words}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found[r["word"]].append(r["match"])
    assert found == want
    assert {(r["word"], r["name"]) for r in Z.resolved(got).collect()} == {("getuser", "get_user"), ("parse_fle", "parse_file")}


def test_empty_sides(spark):
    assert Z.close_pairs(frame(spark, []), None, 0.8).count() == 0
    assert Z.close_pairs(frame(spark, ["a"]), frame(spark, [None, ""]), 0.5).count() == 0
    with pytest.raises(ValueError):
        Z.close_pairs(frame(spark, ["a"]), None, 0)


def test_title_query_over_the_whole_table(spark):
    heads = {}
    for r in Q.observations(spark, SF).select("id", "title").collect():
        if r["title"]:
            heads.setdefault(r["title"], []).append(r["id"])
    want = {(min(heads[a]), min(heads[b]), len(heads[a]), len(heads[b]), round(ratio(a, b), 6)) for a in heads for b in heads if a < b and ratio(a, b) >= 0.9}
    assert {tuple(r) for r in Q.fuzzy_titles(spark, SF).collect()} == want and want


def test_name_query_over_the_whole_table(spark):
    words, possible = ([r["name"] for r in Q.words(spark, SF, t).collect()] for t in ("benchmark", "documents"))
    got = {}
    for r in Q.fuzzy_names(spark, SF).collect():
        got.setdefault(r["word"], []).append((r["rank"], r["match"]))
    assert set(got) <= set(words) and len(got) > 100
    for w in sorted(words)[::29]:
        near = difflib.get_close_matches(w, [p for p in possible if p != w], 3, 0.8)
        assert [m for _, m in sorted(got.get(w, []))] == near


@pytest.mark.parametrize("hot", [2, C.HOT])
def test_names_in_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "SMALL", C.SMALL if hot > 2 else 0)
    rng = random.Random(6)
    lines = ["".join(rng.choices("abcé ", k=rng.randrange(0, 40))) for _ in range(150)] + ["", "aaaaaaaa", "x😀config.toml y", "config.tom", None]
    names = {"".join(rng.choices("abcé ", k=rng.randrange(1, 7))) for _ in range(80)} | {"aaaaa", "config.toml", "never there", "a"}
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string").repartition(3)
    got = [(r["id"], r["name"], r["at"]) for r in C.contained(df, frame(spark, [*names, "a", "", None])).collect()]
    assert sorted(got) == sorted((i, n, line.index(n) + 1) for i, line in enumerate(lines) if line for n in names if n in line)


@pytest.mark.parametrize("window", [1, 50, 1 << 20])
def test_names_by_numbers_in_windows(spark, monkeypatch, window):
    monkeypatch.setattr(C, "WINDOW", window)
    rng = random.Random(7)
    lines = ["".join(rng.choices("ab\u00e9\U0001f600c", k=rng.choice([0, 3, 30, 300]))) for _ in range(60)] + ["x" * 40 + "y", "no\nbreak\x00here"]
    names = {"".join(rng.choices("ab\u00e9\U0001f600c", k=rng.randrange(1, 9))) for _ in range(90)} | {"x" * 20, "x" * 20 + "y", "x" * 21 + "z", "k\x00h", *lines[:3], "".join(lines[:4])} - {""}
    df = spark.createDataFrame([((i, "k"), line) for i, line in enumerate(lines)], "id struct<n: long, k: string>, line string").repartition(2)
    got = [(r["id"]["n"], r["name"], r["at"]) for r in C.contained(df, frame(spark, sorted(names))).collect()]
    assert sorted(got) == sorted((i, n, line.index(n) + 1) for i, line in enumerate(lines) for n in names if n in line)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_names_across_pieces(spark, monkeypatch, width):
    monkeypatch.setattr(C, "WIDTH", width)
    monkeypatch.setattr(C, "SMALL", C.SMALL if width == 3 else 0)
    lines = ["abcdefgh" * 9, "😀b" * 20 + "cdé\nfgh", "abc"]
    names = ["habcdefghab", "b😀b😀bcdé\nf", "cd", "h", "abcdefgh" * 9, "abcdefgh" * 9 + "a"]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = [(r["id"], r["name"], r["at"]) for r in C.contained(df, frame(spark, names)).collect()]
    assert sorted(got) == sorted((i, n, line.index(n) + 1) for i, line in enumerate(lines) for n in names if n in line)


def test_no_names_or_no_lines(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, line string")
    assert C.contained(df, frame(spark, [None, ""])).count() == 0
    assert C.contained(df.limit(0), frame(spark, ["abc"])).count() == 0


def test_no_loop_join_over_lines_and_names(spark):
    plan = Q.names_in_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bitmaps_bound_the_pairs_and_keep_prose_apart():
    """Bags differ in more characters and bigrams than bitmaps in bits; of prose, whose grams are all frequent, few pairs are left to be compared."""
    import pyarrow as pa

    rng = random.Random(8)
    words = ["".join(rng.choices("etaonrish", k=rng.randrange(2, 7))) for _ in range(60)]
    names = sorted({" ".join(rng.choices(words, k=20))[:80] for _ in range(300)})
    names += [n[:40] + rng.choice("xyz") + n[41:] for n in names[:30]] + ["a", "aa", "😀b"]
    bits = Z.bitmaps(names)
    differ = lambda x, y: sum(((Counter(x) - Counter(y)) + (Counter(y) - Counter(x))).values())
    for _ in range(500):
        i, j = rng.randrange(len(names)), rng.randrange(len(names))
        unlike = [bin(int(v)).count("1") for v in bits[i] ^ bits[j]]
        assert sum(unlike[: Z.BITS // 64]) <= differ(names[i], names[j])
        assert sum(unlike[Z.BITS // 64 :]) <= differ(list(zip(names[i], names[i][1:])), list(zip(names[j], names[j][1:])))
    rows = pa.table({"id": range(len(names)), "n": [len(n) for n in names], "bits": [b.tobytes() for b in bits]})
    left = {(r["ia"], r["ib"]) for r in Z._candidates(0.9)(rows, rows).to_pylist() if r["ia"] < r["ib"]}
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if ratio(names[i], names[j]) >= 0.9}
    assert want <= left and len(want) >= 30 and len(left) < 0.02 * len(names) * (len(names) - 1) / 2


def test_few_names_meet_many_in_blocks(spark, monkeypatch):
    """Only numbers, lengths and bitmaps of the many names are exchanged, once for each block of the few."""
    monkeypatch.setattr(Z, "HOT", 25)
    few, many = made(9, 40), made(10, 160)
    rows = [(r["a"], r["b"], r["ratio"]) for r in Z.close_pairs(frame(spark, many), frame(spark, few), 0.8).collect()]
    assert sorted(rows) == sorted((a, b, ratio(a, b)) for a in many for b in few if ratio(a, b) >= 0.8) and rows


def test_names_in_common_order_are_found_before_blocks(monkeypatch):
    """Names of the same characters in another order were all compared block by block."""
    import pandas as pd

    rng = random.Random(11)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b):
                left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    one = ["".join(rng.choices("abcd\u00e9\U0001f600", k=rng.choice([1, 2, 7, 8, 9, 63, 64]))) for _ in range(300)]
    two = [x if k % 5 == 0 else "".join(rng.sample(x, len(x))) + rng.choice("abz") * (k % 3 * 9) for k, x in enumerate(one)]
    got = Z.in_order(one, two).tolist()
    assert got == [plain(a, b) for a, b in zip(one, two)] and all(n >= Z.matched(a, b) for n, a, b in zip(got, one, two))
    for most, n in ((10, 900), (80, 300), (400, 60)):
        letters = "".join(map(chr, range(97, 97 + 12)))
        one = ["".join(rng.choices(letters, k=rng.randrange(most // 2, most))) for _ in range(n)]
        two = [x[:3] + x[4:] if k % 9 == 0 else "".join(rng.sample(x, len(x))) for k, x in enumerate(one)]
        if most == 400:
            one[:9], two[:9] = ["b" * 3] * 9, ["b" * 3 + "c" * k for k in range(9)]
        asked, blocks = [], Z.matched
        monkeypatch.setattr(Z, "matched", lambda a, b: asked.append((a, b)) or blocks(a, b))
        found = next(Z._ratios(0.8)(iter([pd.DataFrame({"a": one, "b": two})])))
        monkeypatch.setattr(Z, "matched", blocks)
        assert sorted(found.itertuples(index=False, name=None)) == sorted((a, b, ratio(a, b)) for a, b in zip(one, two) if ratio(a, b) >= 0.8)
        assert most > 10 or len(asked) < n / 3
    assert next(Z._ratios(0.8)(iter([pd.DataFrame({"a": [], "b": []})]))).empty
