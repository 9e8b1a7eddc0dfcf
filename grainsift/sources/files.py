"""Directory trees as documents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.functions.ship import ship
from grainsift.operators.numbering import dense_ids
from grainsift.operators.verify import MAX_BYTES, indexable

IGNORE_FILES = (".gitignore", ".ignore")


def _rules(folder: str) -> list[tuple[str, bool, bool, bool]]:
    """(pattern, negated, folders only, anchored) of a folder's ignore files."""
    out = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                lines = f.read().splitlines()
        except OSError:
            continue
        for line in lines:
            line = line.rstrip() if not line.rstrip().endswith("\\") else line.rstrip() + " "  # an escaped blank stays
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            only = line.endswith("/")
            line = line.rstrip("/")
            out.append((line.lstrip("/"), negated, only, "/" in line))
    return out


def _matches(pattern: str, rel: str, anchored: bool) -> bool:
    return re.fullmatch(_expression(pattern), rel if anchored else rel.rsplit("/", 1)[-1], re.S) is not None


@lru_cache(4096)
def _expression(pattern: str) -> str:
    """A glob of ignore files: ``**`` over folders, ``*`` and ``?`` within one, classes
    in brackets, a backslash before what stands for itself."""
    out = []
    for p in re.split(r"(\*\*/|\*\*|\*|\?|\\.|\[[!^]?\]?[^\]]*\])", pattern):
        if p in ("**/", "**", "*", "?"):
            out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}[p])
        elif len(p) == 2 and p[0] == "\\":
            out.append(re.escape(p[1]))
        elif len(p) > 2 and p[0] == "[" and p[-1] == "]":
            inner = p[1:-1]
            negated = inner[0] in "!^"
            inner = inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
            out.append(f"(?!/)[{'^' if negated else ''}{inner}]")
        else:
            out.append(re.escape(p))
    return "".join(out)


def crawl(root: str, ignore_rules: bool = True) -> list[str]:
    """Regular files below ``root`` in byte order of their paths. Names that begin
    with a dot and what ignore files exclude are passed over, links aren't followed,
    unreadable folders are dropped."""
    root = os.path.realpath(root)
    found: list[str] = []
    rules: dict[str, list] = {}

    def ignored(folder: str, path: str, is_dir: bool) -> bool:
        verdict = False
        at, chain = folder, []
        while True:
            chain.append(at)
            if at == root:
                break
            at = os.path.dirname(at)
        for base in reversed(chain):
            for pattern, negated, only, anchored in rules.setdefault(base, _rules(base)):
                if (is_dir or not only) and _matches(pattern, os.path.relpath(path, base).replace(os.sep, "/"), anchored):
                    verdict = not negated
        return verdict

    for folder, dirs, files in os.walk(root):
        if ignore_rules:
            dirs[:] = [d for d in dirs if not d.startswith(".") and not ignored(folder, os.path.join(folder, d), True)]
            files = [f for f in files if not f.startswith(".") and not ignored(folder, os.path.join(folder, f), False)]
        found += [p for f in files if os.path.isfile(p := os.path.join(folder, f)) and not os.path.islink(p)]
    return sorted(found, key=os.fsencode)


TOO_LARGE = "larger than 2 GiB"
CONTENT = "path string, content binary, mtime long, size long, error string"


def read_paths(paths: DataFrame) -> DataFrame:
    """``(path, content, mtime, size, error)``, read on the executors (the paths must
    be reachable from them); a file that is missing or larger than 2 GiB has an error
    instead of content."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = mtime = size = error = None
                try:
                    stat = os.stat(path)
                    mtime, size = stat.st_mtime_ns, stat.st_size
                    if size >= MAX_BYTES:  # a cell holds no more; never read
                        error = TOO_LARGE
                    else:
                        with open(path, "rb") as f:
                            content = f.read()
                except OSError as e:
                    error = f"{type(e).__name__}: {e.strerror}"
                kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array([v], t) for v, t in zip((path, content, mtime, size, error), kinds, strict=True)], ["path", "content", "mtime", "size", "error"])

    return paths.select("path").mapInArrow(run, CONTENT)


def read_tree(spark: SparkSession, root: str, ignore_rules: bool = True, files_per_task: int = 512) -> DataFrame:
    """``(doc_id, path, content, mtime, size)``: a tree's files numbered in order of
    path, binary and oversized ones left out. An unreadable file fails the job."""
    names = crawl(root, ignore_rules)
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(names)], "n long, path string")
    listed = listed.repartitionByRange(max(1, len(names) // files_per_task), "n")
    files = read_paths(listed.select("path"))
    files = files.where(~F.col("error").eqNullSafe(TOO_LARGE)).withColumn("content", F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "error")).cast("binary")))
    kept = files.where(indexable(F.col("content")))
    # ids are dense over the files that stay
    numbered = dense_ids(kept.select(F.col("path").alias("numbered")), "numbered")
    return kept.join(numbered, F.col("path") == F.col("numbered")).select("doc_id", "path", "content", "mtime", "size")
