"""Repair of conversations against a plain walk over all edits, in one node each and in trees of many."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.llm import turns

BLANK = "[\x20\x09-\x0d]"


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.sub(BLANK, "", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Dynamic programme over (turn, state), with every audit a string and insertions one by one."""
    best = {0: (0, "")}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def insert(cells):
        again = True
        while again:
            again = False
            for (state, letter), to in step.items():
                if letter != "s" and state in cells:
                    x = (cells[state][0] + 3, cells[state][1] + "I")
                    if to not in cells or x < cells[to]:
                        cells[to], again = x, True
        return cells

    best = insert(best)
    for (_, role, _), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit) in best.items():
            options = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [(to, (0 if letter == role[:1] else 3) + more, "K" if letter == role[:1] else "R") for (s, letter), to in step.items() if s == state and (letter == role[:1] or letter != "s")]
            for to, price, letter in options:
                x = (cost + price, audit + letter)
                if to not in new or x < new[to]:
                    new[to] = x
        best = insert(new)
    cost, audit = min(best[s] for s in (0, 3) if s in best)
    out, row = [], iter(rows)
    for letter in audit:
        r = next(row) if letter != "I" else None
        if letter != "D":
            lead = 1 if out and out[0].startswith("s") else 0
            role = r[1] if letter == "K" else ("user", "assistant")[(len(out) - lead) % 2]
            out.append(f"{role}:{r[2] if r else ''}")
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain(data, order=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())):
    out = set()
    for c in {r[0] for r in data}:
        rows = sorted(((t, " " if role is None else role, " " if x is None else x) for i, t, role, x in data if i == c), key=order)
        faults = plain_faults(rows)
        times = [t for t, _, _ in rows if t is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.add((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, *plain_repair(rows, faults)))
    return out


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "a", "User"]
TEXTS = ["yes.", "no", "", " \n", None, "what?", "same same!", "é.", "so. ", "ok"]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(6)
    data = []
    for c in range(120):
        n = int(rng.integers(1, 9))
        data += [(c if c else None, None if rng.random() < 0.1 else int(t), ROLES[rng.integers(10)], TEXTS[rng.integers(10)] if rng.random() < 0.5 else f"t{t}.") for t in rng.integers(0, 12, n)]
    for c, n in ((500, 700), (501, 90)):  # long ones, one of them full of repeats
        data += [(c, t, ROLES[rng.integers(6)], f"line {t}{'.' * int(rng.integers(2))}" if c == 500 else "ok.") for t in range(n)]
    data += [(600, None, None, None)] * 3 + [(601, 5, "user", "again.")] * 4
    return data


@pytest.mark.parametrize(("chunk", "fan", "parts"), [(turns.CHUNK, turns.FAN, 4), (7, 2, 9)])
def test_repair_against_a_plain_walk(spark, talk, monkeypatch, chunk, fan, parts):
    monkeypatch.setattr(turns, "PIECE", 200 if chunk == 7 else turns.PIECE)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "z", 0, "n") for r in talk], f"{SCHEMA}, c string, h int, `a.b` string").withColumnRenamed("a.b", "place")
        got = {tuple(r) for r in turns.repair(df, chunk=chunk, fan=fan).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain(talk)


def test_products_are_associative_and_equal_the_walk():
    rng = np.random.default_rng(2)
    kinds = list(product("sua?", ("", "truncated", "duplicate")))

    def matrix(some):
        out = {}
        for i in range(4):
            v = turns.begin(i)
            for initial, fault in some:
                v = turns.after_turn(v, initial, fault, 1)
            out |= {(i, j): (*x, ()) for j, x in enumerate(v) if x is not None}
        return out

    for _ in range(300):
        a, b, c = ([kinds[k] for k in rng.integers(0, len(kinds), int(rng.integers(1, 5)))] for _ in range(3))
        left = turns.product(turns.product(matrix(a), matrix(b)), matrix(c))
        right = turns.product(matrix(a), turns.product(matrix(b), matrix(c)))
        assert left == right == matrix(a + b + c)


def test_damage_and_conversations_that_lose_all_rows(spark):
    data = [(c, t, "assistant", f"Is it {t}? Yes! No.") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    want = []
    for c, t, role, x in data:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, x = role or " ", x or " "
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else role, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = [tuple(r) for r in turns.damage(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) != len(data)
    none = turns.repair(turns.damage(df).where("conv_id <> 3"), df).where("conv_id = 3").first()
    assert tuple(none) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repair(turns.damage(empty), empty).count() == 0
    assert turns.repair(empty).where(F.lit(True)).count() == 0
