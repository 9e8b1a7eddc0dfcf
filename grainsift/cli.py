"""Command line: index, query, watch, live."""

from __future__ import annotations

import argparse
import os
import sys
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from grainsift.engine import Engine, LiveSearch
from grainsift.plans.regex import compile_regex
from grainsift.sources.files import crawl
from grainsift.sources.index import Files, index_path
from grainsift.streaming.watch import watch as start_watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grainsift", description="Indexed regular-expression search")
    p.add_argument("--home", default=os.path.expanduser("~/.grainsift"), help="where indexes lie; on a cluster a folder that all executors share")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="build the index of a directory")
    a.add_argument("path", nargs="?", default=".")
    a.add_argument("--docs-per-shard", type=int, default=100_000)
    a.add_argument("--shard-target-postings-bytes", type=int, help="shards of so many bytes of lists instead")
    for flag, kind in (("--spill-min-paths", int), ("--spill-max-pairs-in-mem", int), ("--spill-temp-dir", str)):
        a.add_argument(flag, type=kind, help="accepted; spilling is left to Spark, its folder to spark.local.dir")
    a = sub.add_parser("query", help="print matching lines")
    a.add_argument("text")
    a.add_argument("-p", "--path", default=".")
    a.add_argument("--stats", action="store_true", help="tell candidates, hits and times on the error stream")
    for name in ("watch", "live"):
        a = sub.add_parser(name, help="keep the index up to date" if name == "watch" else "search while files change")
        a.add_argument("path", nargs="?", default=".")
        a.add_argument("--debounce-ms", type=int, default=100)
        a.add_argument("--compact-interval-secs", type=int, default=60)
        a.add_argument("--max-batch-files", type=int, default=256)
        a.add_argument("--verbose", action="store_true")
        if name == "live":
            a.add_argument("--max-results", type=int, default=400)
    return p


class Debouncer:
    """Changes wait until their path has been at rest for a while; of several the last
    counts. Those that have waited longest leave first."""

    def __init__(self, rest_s: float):
        self.rest_s = rest_s
        self.waiting: dict[str, tuple[str, float]] = {}

    def push(self, changes: list[tuple[str, str]], now: float) -> None:
        for path, action in changes:
            self.waiting[path] = (action, now)

    def ready(self, now: float, limit: int | None = None) -> list[tuple[str, str]]:
        at_rest = sorted((at, path) for path, (_, at) in self.waiting.items() if now - at >= self.rest_s)[:limit]
        return [(path, self.waiting.pop(path)[0]) for _, path in at_rest]


def poll(root: str, seen: dict[str, tuple[int, int]], limit: int | None = None) -> list[tuple[str, str]]:
    """Changes of a tree since the last look, in order of path; ``seen`` is updated
    with those returned."""
    now = {}
    for path in crawl(root):
        try:
            s = os.stat(path)
        except OSError:
            continue
        now[path] = (s.st_mtime_ns, s.st_size)
    changed = sorted([(p, "upsert") for p, v in now.items() if seen.get(p) != v] + [(p, "delete") for p in seen if p not in now])[:limit]
    for path, action in changed:
        if action == "upsert":
            seen[path] = now[path]
        else:
            seen.pop(path)
    return changed


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "query":
        try:
            compile_regex(args.text)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    spark = spark or SparkSession.builder.appName("grainsift").getOrCreate()
    engine = Engine(spark, args.home)
    root = os.path.realpath(args.path)
    if args.command == "index":
        began = time.time()
        index = engine.index(root, args.docs_per_shard, target_bytes=args.shard_target_postings_bytes)
        print(f"indexed {index.doc_count} documents in {len(index.manifest['shards'])} shards in {time.time() - began:.1f} s", file=sys.stderr)
        return 0
    if args.command == "query":
        if not engine.has_index(root):
            print(f"no index for {root}; run `grainsift index {args.path}`", file=sys.stderr)
            return 1
        print("\n".join(engine.printed(root, args.text)))
        if args.stats:
            print(engine.measured(engine.query(root, args.text)), file=sys.stderr)
        return 0
    follow(engine, root, args)
    return 0


def typed(lines: Iterable[str], live: LiveSearch, stop: Callable[[], None]) -> None:
    """Submits each line as it comes; the end of input stops the program."""
    for line in lines:
        live.submit(line.rstrip("\n"))
    stop()


def shown(root: str, rows: list, stats: dict) -> str:
    """Rows of a live search for the screen: a path, then its hits."""
    out, last = [], None
    for r in rows:
        if r["kind"] == "hit":
            if r["path"] != last:
                last = r["path"]
                out.append(("./" + last[len(root) + 1 :] if last.startswith(root + "/") else last) + ":")
            out.append(f"  {r['line_no']:>6}: {r['line']}")
    return "\n".join([*out, str(stats)])


def follow(engine: Engine, root: str, args: argparse.Namespace, lines: Iterable[str] | None = None, rounds: int | None = None) -> None:
    """Watches a tree, and searches it with ``live``: a thread reads what is typed, so
    files are followed meanwhile."""
    spark, store = engine.spark, engine.watched(root)
    store.lock()
    query = None
    try:
        feed = f"{index_path(engine.home, root)}/feed"
        Files(spark).make(feed)
        schema = "path string, action string, seq long"
        note = (lambda phase, batch: print(f"{phase} {batch}", file=sys.stderr)) if args.verbose else (lambda phase, batch: None)
        stream = spark.readStream.schema(schema).json(feed)
        query = start_watch(store, stream, f"{feed}-checkpoint", compact_seconds=args.compact_interval_secs, rebuild=lambda paths: engine.rebuild(root, paths), on_status=note)
        stopped = threading.Event()
        if args.command == "live":
            live = LiveSearch(engine, root, lambda n, rows, stats: print(shown(root, rows, stats), flush=True), max_results=args.max_results)
            threading.Thread(target=typed, args=(sys.stdin if lines is None else lines, live, stopped.set), daemon=True).start()
        seen = {r["path"]: (r["mtime"], r["size"]) for r in store.current().where("not tombstone").select("path", "mtime", "size").toLocalIterator()}
        waiting, seq = Debouncer(args.debounce_ms / 1000), time.time_ns()
        while query.isActive and not stopped.wait(max(0.02, args.debounce_ms / 1000)) and rounds != 0:
            rounds = None if rounds is None else rounds - 1
            waiting.push(poll(root, seen), time.monotonic())
            ready = waiting.ready(time.monotonic(), args.max_batch_files)
            if ready:
                rows = [(p, a, seq + i) for i, (p, a) in enumerate(ready)]
                seq += len(rows)
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(feed)
                if args.verbose:
                    print("\n".join(f"{a} {p}" for p, a in ready), file=sys.stderr)
        if rounds is not None:
            query.processAllAvailable()
    except KeyboardInterrupt:
        pass
    finally:
        if query is not None:
            query.stop()
        store.unlock()


if __name__ == "__main__":
    sys.exit(main())
