import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import DOCS, awkward, empty

from grainsift.llm.packing import Capacity, best_fit, pack


def slow(lengths, c):
    """The rule written plainly, with no bin ever closed."""
    bins, out = [], [None] * len(lengths)
    whole = (c.tokens, c.docs, c.attention)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, room in enumerate(bins):
            if all(r >= n for r, n in zip(room, need, strict=True)):
                if c.rule == "dot":
                    score = sum(w * (r / t) * (n / t) for w, r, n, t in zip(c.weights, room, need, whole, strict=True))
                else:
                    score = -sum(w * ((r - n) / t) ** 2 for w, r, n, t in zip(c.weights, room, need, whole, strict=True))
                if best is None or score > best[0] + 1e-12:
                    best = (score, b)
        if best is None:
            bins.append(list(whole))
            best = (0, len(bins) - 1)
        out[i] = best[1]
        for k in range(3):
            bins[best[1]][k] -= need[k]
    return out


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_brute_force(rule):
    rng = random.Random(rule)
    for _ in range(20):
        c = Capacity(100, rng.randint(2, 9), rng.choice([4000, 6000, 10_000]), (1.0, 0.3, 0.6), rule)
        lengths = [rng.randint(1, c.piece) for _ in range(rng.randint(0, 120))]
        assert best_fit(np.array(lengths, np.int64), c).tolist() == slow(lengths, c)


def test_capacities_and_cover(spark):
    rng = random.Random(1)
    c = Capacity(64, 5, 2500)
    sizes = {i: rng.choice([0, 1, 3, 20, 50, 51, 300]) for i in range(300)}
    docs = spark.createDataFrame([(i, "w " * n, "en", "s", 0) for i, n in sizes.items()], DOCS)
    rows = pack(docs, c, shard_docs=80).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["tokens"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r["tokens"])
    for held in bins.values():
        assert sum(held) <= 64 and len(held) <= 5 and sum(n * n for n in held) <= 2500
    for i, n in sizes.items():
        at = 0
        for k, (piece, start, tokens) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (k, at)
            at += tokens
        assert at == n
    assert {r["doc_id"] for r in rows if r["bin_id"] is None} == {i for i, n in sizes.items() if not n}


def test_awkward(spark):
    docs = awkward(spark)
    rows = pack(docs).collect()
    first = [r for r in rows if r["piece"] == 0]
    assert len(first) == docs.count()
    assert sorted(r["copy"] for r in first if r["doc_id"] == 0) == [0, 1, 2]
    assert {r["doc_id"] for r in first if r["bin_id"] is None} >= {100, 101, 102}
    assert len([r for r in rows if r["doc_id"] == 104]) > 5
    assert pack(empty(spark)).count() == 0


def test_bad_capacities():
    with pytest.raises(ValueError):
        Capacity(0)
    with pytest.raises(ValueError):
        Capacity(rule="first")


def test_the_longest_piece_leaves_a_bin_that_can_be_full():
    c = Capacity()
    p = c.piece
    assert p * p + (c.tokens - p) ** 2 <= c.attention < (p + 2) ** 2 + (c.tokens - p - 2) ** 2
    assert Capacity(attention=4096 * 4096).piece == 4096
    assert Capacity(tokens=100, attention=400).piece == 20  # no two pieces fill it
    assert len(set(best_fit(np.array([p, c.tokens - p]), c).tolist())) == 1
