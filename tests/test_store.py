"""Write path, storage round trips and clusters."""

from quillmine.operators import project as P
from quillmine.operators import store as W


def test_snapshot_and_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    W.write_snapshot({"obs": rows}, f"{tmp_path}/snap")
    assert sorted(map(tuple, W.read_snapshot(spark, f"{tmp_path}/snap", ["obs"])["obs"].collect())) == [(1, "a"), (2, "b")]
    W.export_json(rows, f"{tmp_path}/json")
    assert [r["id"] for r in W.import_json(spark, f"{tmp_path}/json", "id long, content string", rows.where("id = 1")).collect()] == [2]


def test_vector_clusters_join_near_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.14, 0.0]), (3, [0.0, 1.0, 0.0])], "id long, embedding array<double>")
    assert sorted(map(tuple, W.vector_clusters(v, 0.9, bits=2).collect())) == [(1, 1), (2, 1)]


def test_save_drops_blanks_private_rows_and_repeats(spark):
    schema = "id long, type string, title string, content string, project_root string"
    store = spark.createDataFrame([(1, "note", "t", "Known", "p")], schema)
    new = spark.createDataFrame([(2, "note", "t", " known ", "p"), (3, "note", "t", "<private>x</private>", "p"), (4, "note", "t", None, "p"), (5, "guardrail", "t", "new", "p"), (6, "note", "t", "NEW", "p"), (7, "note", "t", "new", "q")], schema)
    got = {r["id"]: r["decay_immune"] for r in W.save_batch(store, new, 0).collect()}
    assert got == {5: True, 7: False}


def test_chunks_tile_the_text(spark):
    text = " ".join(f"word{k * k % 997}" for k in range(3000))
    rows = sorted((r["start"], r["size"]) for r in P.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")).collect())
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and sum(n for _, n in rows) == len(text)
    assert all(n <= 1024 for _, n in rows) and all(n >= 128 for _, n in rows[:-1])
