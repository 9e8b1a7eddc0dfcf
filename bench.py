"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from grainsift.engine import indexed_search  # noqa: E402
from grainsift.operators.postings import candidates  # noqa: E402
from grainsift.operators.verify import regex_hits  # noqa: E402
from grainsift.plans.regex import compile_regex  # noqa: E402
from grainsift.sources.index import open_index, write_index  # noqa: E402

PATTERNS = {"none": "zzqqxx", "rare": "double", "medium": "worthless", "alternation": "License|Copyright", "digits": "[0-9]{4}", "class": r"[a-z]{3}\d{2}", "pipe": r"\| "}


def timed(f, repeat: int = 2) -> tuple[float, object]:
    best, out = float("inf"), None
    for _ in range(repeat):
        began = time.time()
        out = f()
        best = min(best, time.time() - began)
    return round(best, 3), out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    home = tempfile.mkdtemp(prefix="grainsift-bench-")
    times: dict[str, float] = {}
    counts: dict[str, dict] = {}
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        docs.select(F.sum(F.length("text"))).collect()  # the JVM is warm
        source = docs.select("doc_id", F.col("source").alias("path"), "text")
        times["index_build"], _ = timed(lambda: write_index(source, f"{home}/index", "text", keep_text=True), 1)
        index = open_index(spark, f"{home}/index")
        for name, pattern in PATTERNS.items():
            regex = compile_regex(pattern)
            times[f"scan_{name}"], hits = timed(lambda p=pattern: regex_hits(docs, p).count())
            times[f"indexed_{name}"], again = timed(lambda p=pattern: indexed_search(index.docs, index.postings, p).count())
            if hits != again:
                raise RuntimeError(f"index and scan differ on {pattern}: {again} and {hits}")
            counts[name] = {"hits": hits, "candidates": candidates(index.postings, regex.plan, index.docs).count()}
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{home}/index") for f in fs if f.endswith(".parquet"))
        print(json.dumps({"metric": "sum of headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "counts": counts, "index_bytes": size, "sf": sf}))
    finally:
        spark.stop()
        shutil.rmtree(home, ignore_errors=True)


if __name__ == "__main__":
    main()
