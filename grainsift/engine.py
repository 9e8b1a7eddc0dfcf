"""Search over trees and tables: index, query, live search."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.functions.lineage import cut
from grainsift.operators.numbering import dense_ids
from grainsift.operators.postings import candidates, forward_predicate
from grainsift.operators.verify import capped_rows, display_path, indexable, regex_hits, verify_contents
from grainsift.plans.regex import Regex, compile_regex
from grainsift.sources.files import read_paths, read_tree
from grainsift.sources.index import DOCS_PER_SHARD, Index, has_index, index_path, open_index, write_index
from grainsift.streaming.watch import WatchStore, live_docs

MAX_RESULTS, MAX_VERIFIED = 400, 1200


@dataclass
class Result:
    """Hits ``(doc_id, path, line_no, line)``, errors ``(doc_id, path, error)``, and
    timings in seconds."""

    hits: DataFrame | None
    errors: DataFrame | None = None
    backend: str = "idle"
    stats: dict = field(default_factory=dict)
    found: DataFrame | None = None


KNOWN_IDS = 4096
"""Candidates up to which their ids are looked up first and pushed into the scan."""
KNOWN_RANGES = 64
BROADCAST_IDS = 2 << 20
"""Candidates up to which their ids are broadcast, at some 88 bytes each."""


def id_ranges(ids: list[int], most: int = KNOWN_RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all ids, split at the widest gaps."""
    ids = sorted(set(ids))
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1]
    cuts = [0, *sorted(i for i in gaps if ids[i] - ids[i - 1] > 1), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def only(docs: DataFrame, found: DataFrame, key: str = "doc_id", known: int = KNOWN_IDS) -> DataFrame:
    """The rows of ``docs`` whose key is in ``found(doc_id)``. A few ids are fetched
    and become ranges that the scan prunes files and row groups by (texts that an
    index stores lie in order of id); more of them stay a join, with the ids broadcast
    while they are small enough, so that texts aren't shuffled."""
    ids = [r[0] for r in found.limit(known + 1).collect()]
    if len(ids) > known:
        more = found.withColumnRenamed("doc_id", key)
        return docs.join(F.broadcast(more) if found.count() <= BROADCAST_IDS else more, key, "left_semi")
    if not ids:
        return docs.limit(0)
    # as SQL text: literals one by one cost more than the lookup
    at = f"`{key}`"
    ranges = " OR ".join(f"{at} = {low}" if low == high else f"({at} >= {low} AND {at} <= {high})" for low, high in id_ranges(ids))
    return docs.where(f"({ranges}) AND {at} IN ({', '.join(map(str, ids))})")


def indexed_search(docs: DataFrame, lists: DataFrame, pattern: str | Regex, text_col: str = "text", known: int = KNOWN_IDS) -> DataFrame:
    """``(doc_id, line_no, line)`` of a table of texts through its posting lists: only
    candidates are read (as far as the order of ``docs`` allows) and matched."""
    regex = compile_regex(pattern) if isinstance(pattern, str) else pattern
    if regex.plan.kind != "union":
        return regex_hits(docs, regex, "doc_id", text_col)
    # the ids are used twice or more, and lists may be made for this search only
    return regex_hits(only(docs, cut(candidates(lists, regex.plan, docs)), known=known), regex, "doc_id", text_col)


class Engine:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home
        self._open: dict[str, Index] = {}

    def index(self, root: str, docs_per_shard: int = DOCS_PER_SHARD, ignore_rules: bool = True, target_bytes: int | None = None) -> Index:
        path = index_path(self.home, root)
        write_index(read_tree(self.spark, root, ignore_rules), path, "content", docs_per_shard, {"root": root}, target_bytes=target_bytes)
        self._open.pop(path, None)
        return self.open(root)

    def rebuild(self, root: str, paths: DataFrame) -> tuple[DataFrame, int]:
        """A new version of the base index of these files as they are now; those that
        can't be read or indexed are left out. Returns its documents and number."""
        path, old = index_path(self.home, root), self.open(root).manifest
        files = cut(read_paths(paths).where(F.col("error").isNull() & indexable(F.col("content"))).select("path", "content", "mtime", "size"))
        docs = files.join(dense_ids(files.select("path"), "path"), "path").select("doc_id", "path", "content", "mtime", "size")
        version = write_index(docs, path, "content", old["docs_per_shard"], {"root": root}, target_bytes=old.get("target_bytes"))
        self._open.pop(path, None)
        return self.open(root).docs, version

    def watched(self, root: str) -> WatchStore:
        """The store of a root, with a snapshot: of the base index if there was none."""
        store, index = self.store(root), self.open(root) if self.has_index(root) else self.index(root)
        if store.current() is None:
            store.bootstrap(index.docs, index=index.version)
        return store

    def compact(self, root: str, upto: int | None = None) -> DataFrame:
        """Folds what the watch store gathered back into a rebuilt base index."""
        store = self.store(root)
        return store.compact(store.last_batch() if upto is None else upto, lambda paths: self.rebuild(root, paths))

    def open(self, root: str) -> Index:
        path = index_path(self.home, root)
        if path not in self._open:
            self._open[path] = open_index(self.spark, path)
        return self._open[path]

    def has_index(self, root: str) -> bool:
        return has_index(self.spark, index_path(self.home, root))

    def store(self, root: str) -> WatchStore:
        return WatchStore(self.spark, index_path(self.home, root) + "/watch")

    def query(self, root: str, pattern: str, limit_docs: int | None = None) -> Result:
        """An invalid pattern fails before the index is looked for. Documents changed
        since the watch snapshot are tested by their own tokens; the others come from
        the base index, if the snapshot is of its version. Contents are read anew,
        so hits are those of the files as they are; what can't be read is an error."""
        began = time.time()
        regex = compile_regex(pattern)
        index = self.open(root)
        store = self.store(root)
        changed, follows = store.changed(), store.base() == index.version
        state = store.current(changed if follows else None)
        opened = time.time()
        found, backend = None, "watch"
        if state is None or follows:
            docs = index.docs if changed is None else index.docs.join(changed, "doc_id", "left_anti")
            found = (docs if regex.plan.kind == "all" else only(docs, candidates(index.postings, regex.plan, index.docs))).select("doc_id", "path")
            backend = "index" if changed is None else "index and watch"
        if state is not None and (changed is not None or not follows):
            live = live_docs(state).where(forward_predicate(F.col("hashes"), regex.plan)).select("doc_id", "path")
            found = live if found is None else found.unionByName(live)
        listed = time.time()
        if limit_docs is not None:
            found = found.orderBy("doc_id").limit(limit_docs)
        files = read_paths(found.select("path")).withColumnRenamed("path", "fp")
        contents = found.join(files, F.col("path") == F.col("fp")).select("doc_id", "path", "content", "error")
        hits, errors = verify_contents(contents, regex, ["doc_id", "path"])
        errors = errors.unionByName(contents.where("error is not null").select("doc_id", "path", "error"))
        stats = {"open_s": opened - began, "plan": regex.plan.kind, "hashes": len({h for b in regex.plan.branches for h in b}), "lookup_s": listed - opened}
        return Result(hits, errors, backend, stats, found.select("doc_id"))

    def measured(self, result: Result) -> dict:
        """Runs the parts of a result and tells what each took: candidates, hits,
        documents with hits, seconds of reading and matching, and of everything."""
        began = time.time()
        candidates_ = result.found.count()
        counted = time.time()
        row = result.hits.agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs")).first()
        done = time.time()
        stats = {"candidates": candidates_, "candidates_s": counted - began, "hits": row["hits"], "docs": row["docs"], "verify_s": done - counted}
        return result.stats | stats | {"total_s": done - began + result.stats["open_s"] + result.stats["lookup_s"]}

    def search(self, root: str, pattern: str, max_results: int = MAX_RESULTS, max_verify: int = MAX_VERIFIED) -> tuple[list, dict]:
        """For interactive use: the first rows of the first candidates, and counts.
        An empty pattern is idle; a failure is told in the counts, not raised."""
        if not pattern:
            return [], {"backend": "idle"}
        try:
            result = self.query(root, pattern, max_verify)
            rows = capped_rows(result.hits, max_results).collect()
            return rows, {"backend": result.backend, "rows": len(rows), "hits": sum(r["kind"] == "hit" for r in rows)} | result.stats
        except (ValueError, OSError) as e:
            return [], {"backend": "error", "error": str(e)}

    def printed(self, root: str, pattern: str) -> list[str]:
        """What the command line shows."""
        result = self.query(root, pattern)
        rows = result.hits.select("doc_id", display_path(F.col("path"), root).alias("path"), "line_no", "line").orderBy("doc_id", "line_no").toLocalIterator()
        out: list[str] = []
        last = None
        for r in rows:
            if r["doc_id"] != last:
                out += ([""] if last is not None else []) + [r["path"]]
                last = r["doc_id"]
            out.append(f"{r['line_no']}:{r['line']}")
        return out


def append_errors(errors: DataFrame, path: str) -> None:
    """Adds verification errors to a log folder, one JSON line each."""
    errors.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


class LiveSearch:
    """Search as one types: waits until typing rests, and only the newest query
    counts; Spark jobs of an older one are cancelled, its rows are never delivered."""

    def __init__(self, engine: Engine, root: str, deliver: Callable[[int, list, dict], None], rest_s: float = 0.07, max_results: int = MAX_RESULTS):
        self.engine, self.root, self.deliver, self.rest_s, self.max_results = engine, root, deliver, rest_s, max_results
        self.newest, self.tag, self.lock = 0, "", threading.Lock()

    def submit(self, pattern: str) -> threading.Thread:
        with self.lock:
            self.newest += 1
            number = self.newest
            if self.tag:
                self.engine.spark.sparkContext.cancelJobsWithTag(self.tag)
        thread = threading.Thread(target=self._run, args=(number, pattern), daemon=True)
        thread.start()
        return thread

    def _run(self, number: int, pattern: str) -> None:
        time.sleep(self.rest_s)
        context, tag = self.engine.spark.sparkContext, f"live-{uuid.uuid4().hex}"
        with self.lock:
            if number != self.newest:
                return
            self.tag = tag
        context.addJobTag(tag)
        try:
            rows, stats = self.engine.search(self.root, pattern, self.max_results)
        except Exception as e:  # a cancelled job fails in Spark's own ways
            rows, stats = [], {"backend": "error", "error": str(e)}
        finally:
            context.removeJobTag(tag)
        with self.lock:
            if number != self.newest:
                return
        self.deliver(number, rows, stats)
