"""Packed posting lists against brute force, with several ranges and sections."""

import random
from collections import defaultdict

import numpy as np
import pytest

from grainsift.functions import packed
from grainsift.functions.ngrams import fnv1a32, ngrams


@pytest.fixture(params=[(2 << 20, 1 << 20, 4 << 20), (500, 7, 900)], ids=["usual", "small"])
def sizes(request, monkeypatch):
    for name, value in zip(("RANGE_BYTES", "SECTION_IDS", "GROUP_PAIRS"), request.param, strict=True):
        monkeypatch.setattr(packed, name, value)


@pytest.fixture(params=[lambda k: k - 20, lambda k: (k * 0x9E3779B97F4A7C15 >> 8) % (1 << 52)], ids=["dense", "scattered"])
def table(request, spark, sizes):
    rng = random.Random(5)
    rows = [(request.param(k), "".join(rng.choice("abc de_1.\n") for _ in range(rng.randint(0, 90)))) for k in range(60)]
    rows += [(request.param(3), "again abc"), (None, "no id"), (request.param(70), None), (request.param(71), "é" * 30)]
    lists = defaultdict(set)
    for d, t in rows:
        if d is not None and t is not None:
            for g in ngrams(t.encode()):
                lists[fnv1a32(g)].add(d)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {h: sorted(ds) for h, ds in lists.items()}, rows


def test_postings(table):
    docs, lists, _ = table
    want = {(h, s): [d for d in ds if d // 10 == s] for h, ds in lists.items() for s in {d // 10 for d in ds}}
    found = packed.fnv_postings(docs, 10).collect()
    assert len(found) == len(want)
    assert {(r["hash"], r["shard_id"]): r["doc_ids"] for r in found} == want
    assert {r["hash"]: r["doc_ids"] for r in packed.fnv_postings(docs).collect()} == lists


def test_document_frequency(table):
    docs, lists, _ = table
    found = packed.fnv_document_frequency(docs).collect()
    assert len(found) == len(lists)
    assert {r["hash"]: r["df"] for r in found} == {h: len(ds) for h, ds in lists.items()}


def varint(n):
    return max(1, min(5, -(-n.bit_length() // 7))) if n >= 0 else 1


def list_bytes(ids):
    return 0 if len(ids) == 1 else varint(len(ids)) + sum(varint(b - a) for a, b in zip([0, *ids[:-1]], ids, strict=True))


def test_posting_bytes(table):
    docs, lists, _ = table
    found = packed.fnv_posting_bytes(docs).collect()
    assert len(found) == len(lists)
    assert {r["hash"]: r["bytes"] for r in found} == {h: list_bytes(ds) for h, ds in lists.items()}


def test_index_stats(table):
    docs, lists, rows = table
    (found,) = packed.fnv_index_stats(docs).collect()
    assert found.asDict() == {
        "pairs": sum(len(ngrams(t.encode())) for d, t in rows if d is not None and t is not None),
        "unique_pairs": sum(map(len, lists.values())),
        "lookup_rows": len(lists),
        "inline_singletons": sum(len(ds) == 1 for ds in lists.values()),
        "payload_bytes": sum(map(list_bytes, lists.values())),
    }


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, None), (None, "abc")], "doc_id long, text string")
    assert packed.fnv_postings(docs, 10).count() == 0
    assert list(packed.fnv_index_stats(docs).first()) == [0] * 5


def test_gaps_and_sums():
    values = np.array([5, 9, 2, 3, 3, 70_000], np.uint64)
    first = np.array([True, False, True, False, False, False])
    stored = packed.planes(packed.gaps(values, first), 3)
    assert packed.sums(packed.unplanes([stored[:, :1], stored[:, 1:]]), np.array([2, 4])).tolist() == values.tolist()
