"""Keyed state with timers: restarts in mid-stream, duplicates, late and unordered rows, and the batch twin."""

import os
import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from quillmine.streaming import sessions as N

START = datetime(2024, 1, 1)
MINUTE = 60_000


def plain(rows, gap=N.GAP_MS):
    out = []
    for user in {r[1] for r in rows}:
        own = sorted((t, k) for _, u, t, k in rows if u == user)
        now = None
        for t, k in own:
            if now is None or t - now[1] >= gap:
                now = [t, t, 0, set()]
                out.append((user, now))
            now[1], now[2] = t, now[2] + 1
            now[3] |= {k} - {None}
    return {(u, a, b, n, tuple(sorted(k))) for u, (a, b, n, k) in out}


def write(folder, name, rows, age):
    frame = {
        "event_id": [r[0] for r in rows], "ts": [None if r[2] is None else START + timedelta(milliseconds=r[2]) for r in rows], "user_id": [r[1] for r in rows],
        "props": [None if r[3] is None else f'{{"k": {r[3]}}}' for r in rows],
    }
    table = pa.table(frame, schema=pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("props", pa.string())]))
    pq.write_table(table, folder / name)
    os.utime(folder / name, (age, age))


def test_restart_duplicates_and_late_rows(spark, tmp_path):
    rng = random.Random(7)
    source = tmp_path / "in"
    source.mkdir()
    files, i = [], 0
    for k in range(4):  # an hour a file, up to nine minutes out of order, and across the border of two files
        rows = []
        for _ in range(60):
            t = k * 60 * MINUTE + rng.randrange(60 * MINUTE) - rng.randrange(9 * MINUTE) * (k > 0)
            rows.append((i, rng.randrange(40), max(t, k * 60 * MINUTE - 5 * MINUTE), rng.choice([None, 1, 2, 3])))
            i += 1
        files.append(rows + rows[:5])  # duplicates in one file
    files[1] += files[0][-3:-1]  # and across files, if they are not late
    good = {r for rows in files for r in rows}
    late = [(9000, 1, 5, 1), (9001, 2, 10 * MINUTE, 2)]
    files[3] += late + [(9100, None, 200 * MINUTE, 1), (9101, 3, None, 1)]
    end = (9999, 99, 100_000 * MINUTE, None)

    def ahead(rows):  # what a file's watermark lets in
        return max(r[2] for r in rows if r[2] is not None) - 10 * MINUTE

    late_copies = [r for r in files[0][-3:-1] if r[2] < ahead(files[0])]
    offset = int((START.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000)
    schema = "event_id long, ts timestamp_ntz, user_id long, props string"
    from pyspark.sql.types import StructType

    def run():
        stream = N.read_events(spark, str(source), StructType.fromDDL(schema), 1)
        N.drain(N.streamed(N.deduplicated(N.calls(stream))), str(tmp_path / "out"), str(tmp_path / "state"))
        return {(r["user"], r["start_ms"] - offset, r["end_ms"] - offset, r["calls"], tuple(r["symbols"])) for r in spark.read.schema(N.RESULT).parquet(str(tmp_path / "out")).collect()}

    write(source, "0.parquet", files[0], 1_700_000_000)
    write(source, "1.parquet", files[1], 1_700_000_100)
    first = run()
    write(source, "2.parquet", files[2], 1_700_000_200)
    write(source, "3.parquet", files[3], 1_700_000_300)
    write(source, "4.parquet", [end], 1_700_000_400)
    whole = run()
    want = plain(good)
    assert len(late_copies) <= 2 and first < whole and 0 < len(first)
    assert whole == want, (whole - want, want - whole)

    batch = N.sessions(N.calls(spark.createDataFrame(pd.DataFrame([(r[0], START + timedelta(milliseconds=r[2]), r[1], None if r[3] is None else f'{{"k": {r[3]}}}') for r in good], columns=["event_id", "ts", "user_id", "props"]), schema)))
    assert {(r["user"], r["start_ms"] - offset, r["end_ms"] - offset, r["calls"], tuple(r["symbols"])) for r in batch.collect()} == want


def test_merging_sessions():
    f = frozenset
    assert N.merged([(0, 5, 2, f({1})), (40, 50, 3, f({2}))], [(20, 20, 1, f({3}))], 21) == [(0, 50, 6, f({1, 2, 3}))]
    assert N.merged([(0, 5, 2, f())], [(26, 26, 1, f())], 21) == [(0, 5, 2, f()), (26, 26, 1, f())]
    assert N.merged([], [], 5) == []


def test_fractions_of_milliseconds_and_the_last_watermark_as_in_sql(spark, tmp_path):
    """Halves round up; a session that ends just when the watermark asks is out; an event without a user moves the watermark."""
    import duckdb

    from quillmine.plans import stream_queries as P

    us = [(0, 1, 500), (1, 1, 1_800_000_499), (2, 2, 1_499), (3, 2, 1_800_001_500), (4, 3, 7_200_000_400), (5, 4, 4_799_999_600), (6, 5, 4_800_000_600), (7, None, 7_200_000_499)]
    table = pa.table({"event_id": [r[0] for r in us], "ts": [START + timedelta(microseconds=r[2]) for r in us], "user_id": [r[1] for r in us], "props": [f'{{"k": {r[0]}}}' for r in us]}, schema=pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("props", pa.string())]))
    for name, rows in (("all", table), ("without", table.slice(0, 4))):
        folder = tmp_path / name
        folder.mkdir()
        pq.write_table(pa.concat_tables([rows, table.slice(7)]), folder / "events.parquet")
        got = {tuple(r) for r in P.stream_sessions(spark, str(folder)).collect()}
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
        want = set(con.execute(P.ORACLES["stream_sessions"]).fetchall())
        assert got == want and len(want) >= 3, (got - want, want - got)


def test_a_user_has_one_timer_and_one_value(spark):
    """However many sessions are open: one timer and one write for an input, and one expiry gives all that are over."""
    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        put = update

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        def getValueState(self, name, schema):
            return State()

        getListState = getValueState

        def registerTimer(self, t):
            calls.append(("timer", t))

        def deleteTimer(self, t):
            calls.append(("no timer", t))

    class Now:
        def __init__(self, t):
            self.t = t

        def getExpiryTimeInMs(self):
            return N.GAP_MS + 60 * MINUTE

        def getCurrentWatermarkInMs(self):
            return self.t

    p = N.Sessions()
    p.init(Handle())
    ms = [k * 60 * MINUTE for k in range(1, 201)]
    frame = pd.DataFrame({"ts": pd.to_datetime(ms, unit="ms"), "symbol": [None, *range(199)]})
    assert list(p.handleInputRows((7,), iter([frame]), Now(0))) == []
    assert calls == ["get", ("timer", ms[0] + N.GAP_MS), "update"]
    calls.clear()
    out = pd.concat(p.handleExpiredTimer((7,), Now(ms[149] + N.GAP_MS), Now(0)))
    assert out["start_ms"].tolist() == ms[:150] and out["symbols"].tolist()[:3] == [[], [0], [1]]
    assert calls == ["get", "update", ("timer", ms[150] + N.GAP_MS)]
    calls.clear()
    out = pd.concat(p.handleExpiredTimer((7,), Now(1 << 50), Now(0)))
    assert len(out) == 50 and calls == ["get", "clear"]
