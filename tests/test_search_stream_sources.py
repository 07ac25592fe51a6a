"""The search loop, the chunked archive as batch and stream, and files."""

import contextlib
import json

import pytest
from pyspark.sql import functions as F

from sievewright.plans import search as G
from sievewright.sources import files as SRC
from sievewright.streaming import archive as T

COLUMNS = [f"c{i}" for i in range(8)] + ["y"]


def theta(**k):
    base = {"one": ["c0", "c1"], "two": ["c0", "c1"], "privacy": ["c0", "c1", "c2", "c3"], "utility": "c0"} | k
    return G.Theta.make(base["one"], base["two"], base["privacy"], base["utility"])


def test_bounds():
    assert G.bounds(8) == {"col_1ds": (3, 4), "col_2ds": (3, 4), "col_ps": (4, 7)}
    assert G.bounds(3) == {"col_1ds": (1, 3), "col_2ds": (2, 3), "col_ps": (1, 2)} and G.bounds(0)["col_ps"] == (1, 6)
    assert G.bounds(10, True)["col_ps"] == (8, 9)


def test_validate_repair_and_edit():
    bad = theta(one=["c0", "nope"])
    assert any("unknown nope" in p for p in G.problems(bad, COLUMNS, "y"))
    good = G.repair(bad, COLUMNS, "y", priority=["c5"])
    assert not G.problems(good, COLUMNS, "y") and "c5" in good.col_1ds
    other = G.apply_actions(good, [{"action": "replace_u", "new": "c3"}, {"action": "replace_1d", "old": "c0", "new": "c7"}])
    assert G.apply_actions(good, G.derive_actions(good, other)) == other and other.id != good.id and len(good.id) == 12
    with pytest.raises(ValueError):
        G.apply_actions(good, [{"action": "replace_u", "new": "c0"}])


def test_search_finds_the_rewarded_column():
    start = G.repair(theta(), COLUMNS, "y")
    rollout = lambda t: {"reward": 0.5 + 0.1 * ("c7" in t.col_1ds) + 0.1 * ("c6" in t.col_2ds), "weak": ["c7", "c6"], "guard_pass": True}
    tree, best = G.run_search(start, COLUMNS, "y", rollout, budget=12, proposals=3, patience=12)
    assert best.q_self > 0.5 and tree.nodes[start.id].n == len(tree.nodes[start.id].children) or best.q_self > 0.5
    assert tree.nodes[start.id].q >= 0.5


def test_backup_mixes_the_best_child():
    tree = G.Tree()
    tree.add(G.Node("r", None, q=0.4, q_self=0.4))
    tree.add(G.Node("a", None, "r", q_self=0.8))
    tree.backup("a")
    assert tree.nodes["a"].q == 0.8 and tree.nodes["r"].q == pytest.approx(0.6)
    assert G.uct(0.5, 1.0, 0, 0, 0.0) == pytest.approx(0.55)


def test_chunk_quota():
    assert T.chunk_slices(10, 4) == [(0, 4), (4, 8), (8, 10)] and T.chunk_size(10) == 1024
    for total, keep, size in ((100, 30, 16), (10, 10, 3), (7, 2, 7)):
        left_keep, left_rows = keep, total
        for a, b in T.chunk_slices(total, size):
            q = T.chunk_quota(b - a, left_keep, left_rows, b == total)
            assert 0 <= q <= b - a
            left_keep, left_rows = left_keep - q, left_rows - (b - a)
        assert left_keep == 0


def test_stream_equals_batch_for_one_chunk(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").where("value is not null").select("event_id", F.round(F.col("value") / 100, 4).alias("o1"), (F.col("user_id") % 100 / 100).alias("o2"))
    n = events.count()
    batch = T.run_chunks(events, T.Archive(spark, "event_id", ("o1", "o2"), 20, n), n, [F.col("event_id")])
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.Archive(spark, "event_id", ("o1", "o2"), 20, n)
    T.run_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), stream, str(tmp_path / "cp")).awaitTermination(120)
    ids = lambda a: {r.event_id for r in a.rows().collect()}
    assert ids(batch) == ids(stream) and len(ids(batch)) == 20
    many = T.run_chunks(events, T.Archive(spark, "event_id", ("o1", "o2"), 20, n), n // 3, [F.col("event_id")])
    assert many.rows().count() <= 1.2 * 20 and sum(h["quota"] for h in many.history) == 20
    many.save(str(tmp_path / "state"))
    again = T.Archive(spark, "event_id", ("o1", "o2"), 20, n)
    again.load(str(tmp_path / "state"))
    assert ids(again) == ids(many)


def test_files(spark, tmp_path):
    (tmp_path / "train.csv").write_text(" a,b\n1,x \n?,\n3,y\n")
    (tmp_path / "test.csv").write_text(" a,b\n4,z\n")
    path = f"{tmp_path}/train.csv"
    rows = SRC.normalize_names(SRC.read_csv(spark, path)).collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, "x"), (None, None), (3.0, "y")]
    assert SRC.count_rows(spark, path) == 3 and SRC.header(spark, path) == [" a", "b"]
    assert SRC.resolve_splits(spark, str(tmp_path))["holdout"].endswith("test.csv")
    with pytest.raises(FileNotFoundError):
        SRC.resolve_source(spark, str(tmp_path))
    (tmp_path / "samples_0.csv").write_text("a\n1\n")
    assert SRC.resolve_source(spark, str(tmp_path)).endswith("samples_0.csv")
    assert SRC.latest(spark, f"{tmp_path}/*.nothing") is None and SRC.latest(spark, f"{tmp_path}/*.csv")
    one = SRC.fingerprint(spark, [path], {"k": 1})
    assert one == SRC.fingerprint(spark, [path], {"k": 1}) != SRC.fingerprint(spark, [path], {"k": 2})
    df = spark.range(3)
    SRC.write_outputs({"t": df}, {"r": {"n": 3}}, str(tmp_path / "out"))
    assert spark.read.parquet(f"{tmp_path}/out/t").count() == 3
    assert json.loads(spark.read.text(f"{tmp_path}/out/r.json").first()[0]) == {"n": 3}
    assert SRC.shared_table(df, str(tmp_path), one).count() == SRC.shared_table(df.limit(0), str(tmp_path), one).count() == 3
    prepared, whole = SRC.prepare({"train": spark.createDataFrame([("1", None), ("2.0", "q")], "n string, c string")}, ["n"], ["c"])
    assert whole == ["n"] and [r.c for r in prepared["train"].collect()] == ["nan", "q"]
    with pytest.raises(ValueError):
        SRC.normalize_names(spark.createDataFrame([(1, 2)], "` a` int, a int"))


def test_a_replayed_batch_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, i / 10, 1 - i / 10) for i in range(10)], "id long, o1 double, o2 double")
    home = f"file://{tmp_path}/archive"
    first = T.Archive(spark, "id", ("o1", "o2"), 4, 20, home=home)
    first.step(rows, 0)
    again = T.Archive(spark, "id", ("o1", "o2"), 4, 20, home=home).resume()
    again.step(rows, 0)
    assert (again.seen, again.kept, again.last_batch) == (first.seen, first.kept, 0) == (10, 2, 0)
    again.step(rows.withColumn("id", F.col("id") + 10), 1)
    assert again.kept == 4 and again.rows().count() == 4


def test_chunks_at_hand_select_as_spark_does(spark, monkeypatch):
    """The same archive, with a few jobs a chunk."""
    rows = spark.range(60).selectExpr("id", "(id * 37 % 5) / 5.0D as a", "(id * 61 % 7) / 7.0D as b").cache()
    run = lambda: {r.id for r in T.run_chunks(rows, T.Archive(spark, "id", ("a", "b"), 12, 60), 30, [F.col("id")]).rows().collect()}
    jobs, real = [], T.P.nsga_select
    monkeypatch.setattr(T.P, "nsga_select", lambda *a: jobs.append(1) or real(*a))
    fast = run()
    assert not jobs and len(fast) == 12
    monkeypatch.setattr(T, "AT_HAND", 0)
    assert run() == fast and jobs


def test_units_by_largest_remainders():
    from sievewright.functions.scalars import largest_remainders
    from sievewright.operators import mix

    assert largest_remainders([1, 1, 1], 5) == [2, 2, 1] and largest_remainders([0.0, 0.0], 3) == [2, 1] and largest_remainders([], 4) == []
    assert mix.allocate_units({"a": 0.5, "b": 0.3, "c": 0.2}, ["c", "b", "a"], 8) == [("c", 2), ("b", 3), ("a", 3)]
    assert mix.allocate_units({"a": 1.0, "b": 0.0}, ["a", "b"], 4) is None


def test_only_timeouts_are_tried_again():
    import threading
    import time
    import urllib.error
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from sievewright.plans import model_client as M

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(self.path)
            if self.path == "/late" and calls.count("/late") < 2:
                time.sleep(1.5)
            self.send_response(500 if self.path == "/bad" else 200)
            self.end_headers()
            with contextlib.suppress(BrokenPipeError):  # the caller gave up
                self.wfile.write(json.dumps({"got": body}).encode())

        def log_message(self, *args):
            pass


    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert M.post_json(f"{url}/fine", {"a": 1}) == {"got": {"a": 1}}
    assert M.post_json(f"{url}/late", {"a": 2}, timeout=0.5, pause=0.01) == {"got": {"a": 2}} and calls.count("/late") == 2
    with pytest.raises(urllib.error.HTTPError):
        M.post_json(f"{url}/bad", {})
    assert calls.count("/bad") == 1
    server.shutdown()
    with pytest.raises(ValueError):
        M.json_in("nothing here")
