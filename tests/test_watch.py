import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from grainsift.cli import Debouncer, follow, parser
from grainsift.engine import Engine
from grainsift.sources.files import crawl
from grainsift.streaming import watch as W


def test_actions(spark):
    events = spark.createDataFrame(
        [("create", "a", None, 1), ("rename", "a", "b", 2), ("remove", "c", None, 3), ("rename_to", "d", None, 4), ("rename_from", "e", None, 5), ("access", "f", None, 6)],
        "kind string, path string, new_path string, seq long",
    ).withColumn("ts", F.current_timestamp())
    got = sorted((r["seq"], r["path"], r["action"]) for r in W.actions(events).collect())
    assert got == [(1, "a", "upsert"), (2, "a", "delete"), (2, "b", "upsert"), (3, "c", "delete"), (4, "d", "upsert"), (5, "e", "delete")]


def test_debounce(spark):
    rows = [("p", "upsert", 0, 1), ("p", "delete", 20, 2), ("p", "upsert", 300, 3)]
    changes = spark.createDataFrame(rows, "path string, action string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))
    fired = W.coalesce(changes).select("action", "events", F.unix_millis("fire_at").alias("at")).orderBy("at").collect()
    assert [tuple(r) for r in fired] == [("delete", 2, 120), ("upsert", 1, 400)]


def test_replay_equals_sequence(spark):
    rng = random.Random(5)
    state = {i: {"path": f"p{i}", "hashes": set(rng.sample(range(9), 3)), "dead": False} for i in range(6)}
    base = [(i, s["path"], 0, 0, sorted(s["hashes"]), False) for i, s in state.items()]
    ops = []
    for seq in range(300):
        doc, op, h = rng.randrange(9), rng.choice(["add", "remove", "add", "tombstone", "upsert_path"]), rng.randrange(9)
        path = f"p{doc}-{seq}"
        ops.append((0, seq, op, doc, h if op in ("add", "remove") else None, path))
        if op == "upsert_path":
            state.setdefault(doc, {"hashes": set()}).update(path=path, dead=False)
        elif doc in state:
            if op == "tombstone":
                state[doc].update(hashes=set(), dead=True)
            elif not state[doc]["dead"]:
                (state[doc]["hashes"].add if op == "add" else state[doc]["hashes"].discard)(h)
    # a document must have a path before its hashes count, as writers ensure
    known = {d for _, _, op, d, _, _ in ops if op == "upsert_path"} | set(range(6))
    got = W.replay(spark.createDataFrame(base, W.STATE), spark.createDataFrame(ops, W.DELTA)).collect()
    assert {r["doc_id"] for r in got} == known
    for r in got:
        want = state[r["doc_id"]]
        assert (r["path"], r["tombstone"]) == (want["path"], want["dead"])
        if r["doc_id"] < 6 and not want["dead"]:
            assert set(r["hashes"]) >= want["hashes"] if any(o[2] == "tombstone" and o[3] == r["doc_id"] for o in ops) else set(r["hashes"]) == want["hashes"]


def live(store):
    return {r["path"]: set(r["hashes"]) for r in W.live_docs(store.current()).collect()}


def rebuilt(spark, root):
    paths = spark.createDataFrame([(p,) for p in crawl(root)], "path string")
    return {r["path"]: set(r["hashes"]) for r in W.file_contents(spark, paths).collect()}


@pytest.fixture
def setup(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for n in "abc":
        (root / f"{n}.txt").write_text(f"{n} alpha\n")
    engine = Engine(spark, str(tmp_path / "home"))
    index = engine.index(str(root))
    store = engine.store(str(root))
    store.bootstrap(index.docs)
    return root, engine, store


def change(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path string, action string, seq long")


def test_store(spark, setup):
    root, engine, store = setup
    a, b, d = (str(root / f"{n}.txt") for n in "abd")
    (root / "a.txt").write_text("changed needle\n")
    (root / "b.txt").unlink()
    (root / "d.txt").write_text("new needle\n")
    batch = change(spark, [(a, "delete"), (a, "upsert"), (b, "delete"), (d, "upsert"), (str(root / "none"), "delete")])
    store.apply(batch, 0)
    store.apply(batch, 0)  # a repeated batch changes nothing
    assert live(store) == rebuilt(spark, str(root))
    assert sorted(r["line"] for r in engine.query(str(root), "needle").hits.collect()) == ["changed needle", "new needle"]
    assert engine.query(str(root), "needle").backend == "watch"
    # deleted, then made again: it revives under its id
    (root / "b.txt").write_text("back needle\n")
    store.apply(change(spark, [(b, "upsert")]), 1)
    ids = {r["path"]: r["doc_id"] for r in store.current().collect()}
    assert (ids[b], ids[d]) == (1, 3)
    assert live(store) == rebuilt(spark, str(root))
    # binary now: a delete
    (root / "b.txt").write_bytes(b"\0\1\2")
    store.apply(change(spark, [(b, "upsert")]), 2)
    assert b not in live(store)
    compacted = {r["path"]: r["doc_id"] for r in store.compact(2).collect()}
    assert compacted == {a: 0, str(root / "c.txt"): 1, d: 2}
    store.apply(change(spark, [(d, "delete")]), 2)  # a batch before the snapshot
    assert d in live(store)
    store.apply(change(spark, [(d, "delete")]), 3)
    assert d not in live(store)


def test_compaction_rebuilds_the_base_index(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for n in "abcde":
        (root / f"{n}.txt").write_text(f"{n} alpha\n")
    engine, at = Engine(spark, str(tmp_path / "home")), str(root)
    store = engine.watched(at)
    a, b, c, f = (str(root / f"{n}.txt") for n in "abcf")

    def hits(pattern):
        result = engine.query(at, pattern)
        return result.backend, sorted(r["path"] for r in result.hits.collect())

    assert hits("alpha") == ("index", [str(root / f"{n}.txt") for n in "abcde"])
    (root / "a.txt").write_text("changed needle\n")
    (root / "f.txt").write_text("new needle\n")
    (root / "b.txt").unlink()
    store.apply(change(spark, [(a, "upsert"), (f, "upsert"), (b, "delete")]), 0)
    assert store.last_batch() == 0
    # changed documents by their own tokens, the others from the index
    assert hits("needle") == ("index and watch", [a, f])
    assert hits("alpha") == ("index and watch", [str(root / f"{n}.txt") for n in "cde"])
    (root / "c.txt").unlink()  # nobody told
    compacted = engine.compact(at)
    assert [r["path"] for r in compacted.orderBy("doc_id").collect()] == [a, str(root / "d.txt"), str(root / "e.txt"), f]
    index = engine.open(at)
    assert index.version == 2 == store.base() and store.changed() is None
    assert [r["path"] for r in index.docs.orderBy("doc_id").collect()] == [r["path"] for r in compacted.orderBy("doc_id").collect()]
    assert hits("needle") == ("index", [a, f]) and hits("alpha") == ("index", [str(root / "d.txt"), str(root / "e.txt")])
    assert engine.query(at, "alpha").errors.count() == 0
    store.apply(change(spark, [(f, "delete")]), 1)
    assert hits("needle") == ("index and watch", [a])
    assert engine.measured(engine.query(at, "needle"))["docs"] == 1


def test_compaction_by_seconds(spark, setup, tmp_path):
    root, engine, store = setup
    feed, schema = tmp_path / "feed", "path string, action string, seq long"
    times, heard = iter([0.0, 5.0, 61.0, 62.0, 70.0]), []
    for i in range(3):
        (root / f"n{i}.txt").write_text("x\n")
        change(spark, [(str(root / f"n{i}.txt"), "upsert")]).coalesce(1).write.mode("append").json(str(feed))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(feed))
    W.watch(store, stream, str(tmp_path / "cp"), {"availableNow": True}, 60, on_status=lambda *s: heard.append(s), clock=lambda: next(times)).awaitTermination(180)
    assert [s for s in heard if s[0] == "compacting"] == [("compacting", 1)]
    assert live(store) == rebuilt(spark, str(root))


def test_debouncer():
    d = Debouncer(0.1)
    d.push([("a", "upsert"), ("b", "upsert")], 0.0)
    d.push([("a", "delete")], 0.06)
    assert d.ready(0.05) == []
    assert d.ready(0.11) == [("b", "upsert")]
    d.push([("c", "upsert")], 0.12)
    assert d.ready(0.3, 1) == [("a", "delete")]
    assert d.ready(0.3, 1) == [("c", "upsert")]
    assert d.ready(9.0) == []


def test_following_and_typing_at_once(spark, tmp_path, capsys):
    root = tmp_path / "t"
    root.mkdir()
    (root / "a.txt").write_text("alpha\n")
    engine = Engine(spark, str(tmp_path / "home"))
    args = parser().parse_args(["live", str(root), "--debounce-ms", "20"])
    silent = threading.Event()

    def lines():
        (root / "b.txt").write_text("beta needle\n")  # while nothing is typed
        silent.wait(60)
        yield "needle\n"
        silent.clear()
        silent.wait(60)

    def told():
        for _ in range(300):
            if (live_now := engine.store(str(root)).changed()) is not None and live_now.count():
                silent.set()
                return
            time.sleep(0.2)

    threading.Thread(target=told, daemon=True).start()
    closing = threading.Timer(45, silent.set)
    closing.start()
    follow(engine, str(root), args, lines(), rounds=900)
    closing.cancel()
    assert "./b.txt:\n       1: beta needle" in capsys.readouterr().out


def test_unchanged_fingerprint_needs_nothing(spark, setup):
    root, _, store = setup
    store.apply(change(spark, [(str(root / "a.txt"), "upsert")]), 0)
    assert spark.read.schema(W.DELTA).parquet(f"{store.path}/delta").count() == 0


def test_lock(setup):
    _, _, store = setup
    store.lock()
    with pytest.raises(RuntimeError):
        store.lock()
    store.unlock()
    store.lock()
    store.unlock()


def test_stream(spark, setup, tmp_path):
    root, _, store = setup
    feed = tmp_path / "feed"
    schema = "path string, action string, seq long"
    (root / "a.txt").write_text("first\n")
    change(spark, [(str(root / "a.txt"), "upsert")]).write.json(str(feed))
    (root / "e.txt").write_text("second\n")
    stream = spark.readStream.schema(schema).json(str(feed))
    heard = []
    W.watch(store, stream, str(tmp_path / "cp"), {"availableNow": True}, on_status=lambda *s: heard.append(s)).awaitTermination(120)
    assert heard == [("updating", 0), ("idle", 0)]
    change(spark, [(str(root / "e.txt"), "upsert")]).write.mode("append").json(str(feed))
    W.watch(store, stream, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(120)
    assert live(store) == rebuilt(spark, str(root))


def test_dense_ids(spark):
    from grainsift.operators.numbering import dense_ids

    names = random.Random(1).sample(range(10**6), 500)
    rows = spark.createDataFrame([(f"{n:07}", n) for n in names], "path string, n long").repartition(7)
    got = {r["n"]: r["doc_id"] for r in dense_ids(rows, "path", per_part=60).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}
    assert dense_ids(rows.limit(0), "path").count() == 0
