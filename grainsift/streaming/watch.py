"""Incremental maintenance: change events, deltas, merge-on-read, compaction.

State is a table ``(doc_id, path, mtime, size, hashes, tombstone)``; a delta is an
append-only table ``(batch, seq, op, doc_id, hash, path)``. Batches are written by
number, so a repeated batch replaces itself.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainsift.functions.ngrams import forward_tokens
from grainsift.operators.numbering import dense_ids
from grainsift.operators.postings import array_difference
from grainsift.operators.verify import indexable
from grainsift.sources.files import read_paths
from grainsift.sources.index import Files

ADD, REMOVE, TOMBSTONE, UPSERT_PATH = "add", "remove", "tombstone", "upsert_path"
STATE = "doc_id long, path string, mtime long, size long, hashes array<long>, tombstone boolean"
DELTA = "batch long, seq long, op string, doc_id long, hash long, path string"


# --- events ----------------------------------------------------------------


def actions(events: DataFrame) -> DataFrame:
    """``(path, action, ts, seq)`` from raw notices ``(kind, path, new_path, ts,
    seq)``: create and modify upsert, remove deletes, a rename does both; anything
    else is passed over. Works on streams."""
    kind = F.col("kind")

    def one(path: Column, what: str) -> Column:
        return F.struct(path.alias("path"), F.lit(what).alias("action"))

    upsert, delete = F.array(one(F.col("path"), "upsert")), F.array(one(F.col("path"), "delete"))
    both = F.array(one(F.col("path"), "delete"), one(F.col("new_path"), "upsert"))
    made = F.when(kind.isin("create", "modify", "rename_to"), upsert).when(kind.isin("remove", "rename_from"), delete).when(kind == "rename", both)
    return events.select(F.explode(made).alias("a"), "ts", "seq").select("a.path", "a.action", "ts", "seq")


def latest(changes: DataFrame) -> DataFrame:
    """The last action for each path, ``(path, action, seq)``."""
    return changes.groupBy("path").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def coalesce(changes: DataFrame, gap: str = "100 milliseconds") -> DataFrame:
    """``(path, action, events, fire_at)``: changes of a path closer than the gap
    become one, the last action wins; it fires a gap after the last. Works on
    streams that have a watermark on ``ts``."""
    window = F.session_window("ts", gap)
    return changes.groupBy("path", window.alias("w")).agg(F.max_by("action", "seq").alias("action"), F.count("*").alias("events")).select("path", "action", "events", F.col("w.end").alias("fire_at"))


# --- deltas ----------------------------------------------------------------


def delta_ops(state: DataFrame, changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Operations ``(seq, op, doc_id, hash, path)`` that bring ``state`` up to date.

    ``changes(path, action)`` has one row a path, ``contents(path, mtime, size,
    hashes)`` those paths that can be indexed; an upsert without contents is a
    delete. A known and a live path with an unchanged fingerprint needs nothing; a
    new path gets the next id in order of path; a tombstone revives; deleting what
    is unknown or gone does nothing.
    """
    known = state.select("doc_id", F.col("path").alias("p"), "mtime", "size", "hashes", "tombstone")
    new = contents.select(F.col("path").alias("cp"), F.col("mtime").alias("m"), F.col("size").alias("s"), F.col("hashes").alias("h"))
    rows = changes.join(new, F.col("path") == F.col("cp"), "left").join(known, F.col("path") == F.col("p"), "left")
    upsert = (F.col("action") == "upsert") & F.col("cp").isNotNull()
    live = F.col("doc_id").isNotNull() & ~F.col("tombstone")
    rows = rows.withColumn("kind", F.when(upsert, "upsert").when(live, "delete")).where("kind is not null")
    same = live & (F.col("mtime") == F.col("m")) & (F.col("size") == F.col("s"))
    rows = rows.where((F.col("kind") == "delete") | ~F.coalesce(same, F.lit(False)))
    top = state.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("top"))
    fresh = dense_ids(rows.where("doc_id is null").select("path"), "path", "n")
    ids = fresh.crossJoin(F.broadcast(top)).select(F.col("path").alias("np"), (F.col("top") + 1 + F.col("n")).alias("new_id"))  # top is one row
    rows = rows.join(ids, F.col("path") == F.col("np"), "left").withColumn("id", F.coalesce("doc_id", "new_id"))
    empty = F.array().cast("array<long>")
    old = F.when(live, F.col("hashes")).otherwise(empty)
    diff = array_difference(old, F.when(F.col("kind") == "upsert", F.col("h")).otherwise(empty))

    def op(name: str, h: Column) -> Column:
        return F.struct(F.lit(name).alias("op"), h.cast("long").alias("hash"))

    none = F.lit(None)
    listed = F.concat(
        F.when((F.col("kind") == "upsert") & ~F.coalesce(live, F.lit(False)), F.array(op(UPSERT_PATH, none))).otherwise(F.array().cast("array<struct<op:string,hash:bigint>>")),
        F.transform(diff["removed"], lambda h: op(REMOVE, h)),
        F.transform(diff["added"], lambda h: op(ADD, h)),
        F.when(F.col("kind") == "delete", F.array(op(TOMBSTONE, none))).otherwise(F.array().cast("array<struct<op:string,hash:bigint>>")),
    )
    return rows.select("path", "id", F.posexplode(listed).alias("k", "o")).select(F.col("k").cast("long").alias("seq"), "o.op", F.col("id").alias("doc_id"), "o.hash", "path")


def replay(state: DataFrame, delta: DataFrame) -> DataFrame:
    """State with a delta applied, by the last operation on each document and hash.

    Additions and removals are idempotent; those of a document that was never
    given a path are passed over. A tombstone clears what came before; a later
    upsert of the path revives the document.
    """
    order = F.struct("batch", "seq")
    known = state.select("doc_id", "path", "mtime", "size", "hashes", "tombstone")
    of_docs = delta.where(F.col("op").isin(TOMBSTONE, UPSERT_PATH)).groupBy("doc_id")
    of_docs = of_docs.agg(
        F.max_by("op", order).alias("last_op"),
        F.max_by("path", F.when(F.col("op") == UPSERT_PATH, order)).alias("new_path"),
        F.max(F.when(F.col("op") == TOMBSTONE, order)).alias("cleared"),
    ).withColumnRenamed("doc_id", "dd")
    marks = delta.where(F.col("op").isin(ADD, REMOVE)).groupBy("doc_id", "hash").agg(F.max_by("op", order).alias("op"), F.max(order).alias("at"))
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "op", "at")).alias("marks")).withColumnRenamed("doc_id", "md")
    joined = known.join(of_docs, F.col("doc_id") == F.col("dd"), "full").withColumn("doc_id", F.coalesce("doc_id", "dd"))
    joined = joined.join(marks, F.col("doc_id") == F.col("md"), "left")
    empty = F.array().cast("array<long>")
    valid = F.filter(F.coalesce("marks", F.array().cast("array<struct<hash:bigint,op:string,at:struct<batch:bigint,seq:bigint>>>")), lambda m: F.col("cleared").isNull() | (m["at"] > F.col("cleared")))
    base = F.when(F.col("cleared").isNull(), F.coalesce("hashes", empty)).otherwise(empty)
    added = F.transform(F.filter(valid, lambda m: m["op"] == ADD), lambda m: m["hash"])
    removed = F.transform(F.filter(valid, lambda m: m["op"] == REMOVE), lambda m: m["hash"])
    gone = F.when(F.col("last_op").isNotNull(), F.col("last_op") == TOMBSTONE).otherwise(F.coalesce("tombstone", F.lit(False)))
    out = joined.where(F.coalesce("path", "new_path").isNotNull())
    hashes = F.when(gone, empty).otherwise(F.sort_array(F.array_union(F.array_except(base, removed), added)))
    return out.select("doc_id", F.coalesce("new_path", "path").alias("path"), "mtime", "size", hashes.alias("hashes"), gone.alias("tombstone"))


def live_docs(state: DataFrame) -> DataFrame:
    return state.where(~F.col("tombstone"))


def renumber(docs: DataFrame, per_part: int = 100_000) -> DataFrame:
    """Live documents with ids from 0 in order of path, as compaction gives them."""
    return dense_ids(live_docs(docs).drop("doc_id"), "path", "doc_id", per_part)


# --- store and stream ------------------------------------------------------


def file_contents(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """``(path, mtime, size, hashes)`` of the paths that exist and can be indexed."""
    files = read_paths(paths).where(F.col("error").isNull() & indexable(F.col("content")))
    return forward_tokens(files, ["path", "mtime", "size"], "content")


class WatchStore:
    """A snapshot and the deltas after it, with one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, contents: Callable[[SparkSession, DataFrame], DataFrame] = file_contents):
        self.spark, self.path, self.contents, self.files = spark, path, contents, Files(spark)

    def _pointer(self) -> dict | None:
        at = f"{self.path}/SNAPSHOT"
        return json.loads(self.files.read(at)) if self.files.exists(at) else None

    def lock(self) -> None:
        """Fails if another writer holds the store."""
        try:
            self.files.write(f"{self.path}/LOCK", str(time.time()), overwrite=False)
        except Exception as e:
            raise RuntimeError(f"another watcher holds {self.path}") from e

    def unlock(self) -> None:
        self.files.remove(f"{self.path}/LOCK")

    def checkpoint(self, state: DataFrame, upto: int, index: int | None = None) -> None:
        """Writes a new snapshot that holds the batches up to ``upto``; ``index`` is the
        version of the base index with the same documents, if there is one."""
        old = self._pointer()
        version = old["version"] + 1 if old else 0
        state.write.mode("overwrite").parquet(f"{self.path}/snapshots/v={version}")
        self.files.replace(f"{self.path}/SNAPSHOT", json.dumps({"version": version, "batch": upto, "index": index}))

    def base(self) -> int | None:
        """The version of the base index that the snapshot belongs to."""
        at = self._pointer()
        return at.get("index") if at else None

    def last_batch(self) -> int:
        """The number of the last batch that was applied, -1 before the first."""
        at = self._pointer()
        last = at["batch"] if at else -1
        if self.files.exists(f"{self.path}/delta"):
            newest = self.spark.read.schema(DELTA).parquet(f"{self.path}/delta").agg(F.max("batch")).first()[0]
            last = last if newest is None else max(last, newest)
        return last

    def bootstrap(self, docs: DataFrame, upto: int = -1, index: int | None = None) -> None:
        """A snapshot from ``docs(doc_id, path)``: missing files are left out, those
        that became binary stay without hashes."""
        found = read_paths(docs.select("path")).where("error is null").select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"))
        have = self.contents(self.spark, docs.select("path")).select(F.col("path").alias("cp"), "hashes")
        rows = docs.select("doc_id", "path").join(found, "path").join(have, F.col("path") == F.col("cp"), "left")
        empty = F.array().cast("array<long>")
        self.checkpoint(rows.select("doc_id", "path", F.col("m0").alias("mtime"), F.col("s0").alias("size"), F.coalesce("hashes", empty).alias("hashes"), F.lit(False).alias("tombstone")), upto, index)

    def changed(self) -> DataFrame | None:
        """``(doc_id)`` of the documents that deltas after the snapshot are about; None
        if there are no such deltas."""
        at = self._pointer()
        if at is None or not self.files.exists(f"{self.path}/delta"):
            return None
        return self.spark.read.schema(DELTA).parquet(f"{self.path}/delta").where(F.col("batch") > at["batch"]).select("doc_id").distinct()

    def current(self, ids: DataFrame | None = None) -> DataFrame | None:
        """Snapshot and deltas merged, of all documents or those of ``ids(doc_id)``; None
        if nothing was ever written."""
        at = self._pointer()
        if at is None:
            return None
        state = self.spark.read.schema(STATE).parquet(f"{self.path}/snapshots/v={at['version']}")
        if ids is not None:
            state = state.join(ids, "doc_id", "left_semi")
        if not self.files.exists(f"{self.path}/delta"):
            return state
        delta = self.spark.read.schema(DELTA).parquet(f"{self.path}/delta").where(F.col("batch") > at["batch"])
        merged = replay(state, delta)
        prints = f"{self.path}/prints"
        if not self.files.exists(prints):
            return merged
        # fingerprints of files changed since the snapshot
        seen = self.spark.read.schema("batch long, path string, m long, s long").parquet(prints).where(F.col("batch") > at["batch"])
        seen = seen.groupBy(F.col("path").alias("sp")).agg(F.max_by("m", "batch").alias("m"), F.max_by("s", "batch").alias("s"))
        joined = merged.join(seen, F.col("path") == F.col("sp"), "left")
        return joined.select("doc_id", "path", F.coalesce("m", "mtime").alias("mtime"), F.coalesce("s", "size").alias("size"), "hashes", "tombstone")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One batch of ``changes(path, action, seq)``; repeating it changes nothing."""
        at = self._pointer()
        if at is not None and batch <= at["batch"]:
            return
        # what an earlier attempt at this batch left must not be read as state
        for part in ("delta", "prints"):
            self.files.remove(f"{self.path}/{part}/batch={batch}")
        last = latest(changes).persist()
        state = self.current()
        if state is None:
            state = self.spark.createDataFrame([], STATE)
            self.checkpoint(state, -1)
        contents = self.contents(self.spark, last.where("action = 'upsert'").select("path")).persist()
        delta_ops(state, last, contents).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        contents.select("path", F.col("mtime").alias("m"), F.col("size").alias("s")).write.mode("overwrite").parquet(f"{self.path}/prints/batch={batch}")
        contents.unpersist()
        last.unpersist()

    def compact(self, upto: int, rebuild: Callable[[DataFrame], tuple[DataFrame, int]] | None = None) -> DataFrame:
        """Folds deltas into a new snapshot with ids 0, 1, … by path, and drops them.

        ``rebuild`` is given the paths of live documents and returns ``(docs(doc_id,
        path), version)`` of a base index built anew from what these files hold now:
        the snapshot is then of those, and files that vanished or became binary are
        gone from both.
        """
        fresh = renumber(self.current())
        if rebuild is None:
            self.checkpoint(fresh, upto)
        else:
            docs, version = rebuild(fresh.select("path"))
            self.bootstrap(docs, upto, version)
        for part in ("delta", "prints"):
            self.files.remove(f"{self.path}/{part}")
        return self.current()


def watch(
    store: WatchStore,
    changes: DataFrame,
    checkpoint_dir: str,
    trigger: dict | None = None,
    compact_seconds: float | None = 60,
    rebuild: Callable[[DataFrame], tuple[DataFrame, int]] | None = None,
    on_status: Callable[[str, int], None] = lambda phase, batch: None,
    clock: Callable[[], float] = time.monotonic,
) -> StreamingQuery:
    """Starts a stream of ``changes(path, action, ts, seq)`` into the store; within
    a micro-batch the last action on a path wins. Compacts with the first batch after
    each ``compact_seconds`` (None: never): without changes there is nothing to fold.
    ``on_status`` hears of each phase (updating, compacting, idle) with its batch."""
    last = [clock()]

    def run(batch: DataFrame, number: int) -> None:
        on_status("updating", number)
        store.apply(batch, number)
        if compact_seconds is not None and clock() - last[0] >= max(1, compact_seconds):
            on_status("compacting", number)
            store.compact(number, rebuild)
            last[0] = clock()
        on_status("idle", number)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"processingTime": "1 second"})).start()
