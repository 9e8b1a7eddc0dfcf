"""Versioned indexes on any file system that Spark can write to."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.functions.ngrams import fnv1a64_hex
from grainsift.operators.postings import payload_sizes, shard_plan, text_postings

FORMAT_VERSION = 1
DOCS_PER_SHARD = 100_000
TEXT_GROUP_BYTES = 1 << 20


def index_path(home: str, root: str) -> str:
    """Where the index of a root lies."""
    return f"{home}/indexes/{fnv1a64_hex(os.path.realpath(root))}"


class Files:
    """The few small files beside the tables, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = True) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Readers see the old text or the new one: it is written aside and renamed."""
        fs, p = self._at(path)
        aside = f"{path}.{uuid.uuid4().hex}"
        self.write(aside, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.isAbsolute() and p.toUri().getScheme() else fs.getUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context.rename(self.jvm.org.apache.hadoop.fs.Path(aside), p, array)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


@dataclass
class Index:
    """An opened version: ``docs(doc_id, path, …)`` and ``postings(hash, shard_id,
    doc_ids)``."""

    spark: SparkSession
    path: str
    version: int
    manifest: dict
    docs: DataFrame
    postings: DataFrame

    @property
    def doc_count(self) -> int:
        return self.manifest["doc_count"]


def current_version(spark: SparkSession, path: str) -> int | None:
    files = Files(spark)
    return int(files.read(f"{path}/CURRENT")) if files.exists(f"{path}/CURRENT") else None


def write_index(docs: DataFrame, path: str, text_col: str = "content", docs_per_shard: int = DOCS_PER_SHARD, extra: dict | None = None, keep_text: bool = False, target_bytes: int | None = None) -> int:
    """Writes a new version and makes it current; returns its number.

    Lists are sorted by hash within each file, so that a query's hashes prune row
    groups, and hold one range of documents each. With ``keep_text`` documents are
    stored with their texts, in order of id and in small row groups, so that the ids
    of candidates prune them. With ``target_bytes`` shards hold so many bytes of
    lists instead of ``docs_per_shard`` documents (one document at least): documents
    are measured first, in a pass of their own.
    """
    spark = docs.sparkSession
    files = Files(spark)
    version = (current_version(spark, path) or 0) + 1
    target = f"{path}/v={version}"
    files.remove(target)  # what a failed attempt left
    if keep_text:
        stored = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", str(TEXT_GROUP_BYTES))
        stored.option("parquet.page.size.row.check.min", "10").option("parquet.block.size.row.check.min", "10").parquet(f"{target}/docs")
    else:
        docs.drop(text_col).write.parquet(f"{target}/docs")
    bases = None
    if target_bytes:
        bases = [r["doc_base"] for r in shard_plan(payload_sizes(docs, text_col), target_bytes).orderBy("shard_id").select("doc_base").collect()] or [0]
    lists = text_postings(docs, docs_per_shard, text_col, bases)
    lists.write.option("parquet.block.size", str(4 << 20)).parquet(f"{target}/postings")
    saved = spark.read.parquet(f"{target}/docs")
    if bases is None:
        shard = F.floor(F.col("doc_id") / docs_per_shard)
    else:
        edges = spark.createDataFrame([(i, b, e) for i, (b, e) in enumerate(zip(bases, [*bases[1:], 1 << 62], strict=True))], "s long, b long, e long")
        shard = F.col("s")
        saved = saved.join(F.broadcast(edges), (F.col("doc_id") >= F.col("b")) & (F.col("doc_id") < F.col("e")))  # a row for each shard
    counts = saved.groupBy(shard.alias("shard_id")).agg(F.count("*").alias("n")).orderBy("shard_id").collect()
    shards, base = [], 0
    for r in counts:
        shards.append({"shard_id": len(shards), "doc_base": base, "doc_count": r["n"]})
        base += r["n"]
    manifest = {"format_version": FORMAT_VERSION, "doc_count": base, "docs_per_shard": docs_per_shard, "target_bytes": target_bytes, "shards": shards} | (extra or {})
    files.write(f"{target}/manifest.json", json.dumps(manifest, sort_keys=True))
    files.replace(f"{path}/CURRENT", str(version))
    return version


def check_manifest(manifest: dict) -> None:
    if manifest.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"unsupported index format {manifest.get('format_version')}")
    base = 0
    for i, s in enumerate(manifest["shards"]):
        if s["shard_id"] != i or s["doc_base"] != base:
            raise ValueError(f"corrupt manifest: shard {i}")
        base += s["doc_count"]
    if base != manifest["doc_count"]:
        raise ValueError("corrupt manifest: document total")


def has_index(spark: SparkSession, path: str) -> bool:
    version = current_version(spark, path)
    return version is not None and Files(spark).exists(f"{path}/v={version}/manifest.json")


def open_index(spark: SparkSession, path: str) -> Index:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no index at {path}: build one with `index` first")
    target = f"{path}/v={version}"
    manifest = json.loads(Files(spark).read(f"{target}/manifest.json"))
    check_manifest(manifest)
    return Index(spark, path, version, manifest, spark.read.parquet(f"{target}/docs"), spark.read.parquet(f"{target}/postings"))
