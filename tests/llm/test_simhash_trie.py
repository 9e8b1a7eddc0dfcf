import random

import numpy as np
import pytest
from fixtures import DOCS, awkward, empty, prose

from grainsift.llm import simhash_trie as S


@pytest.mark.parametrize("bits", [4, 8, 10])
def test_trie_finds_every_pair(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    near = [k ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, bits + 3), replace=False))) for k in base for _ in range(4)]
    keys = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= bits}
    for top in (0, 3, 10, 12, 13):
        found = set()
        for first in range(6):
            turned = S._rotate(keys, first)
            order = np.argsort(turned)
            prefixes = np.unique(turned >> np.uint64(64 - top)).tolist() if top else [None]
            for own in prefixes:
                for i, j in S.trie_pairs(turned[order], bits, top, own, first):
                    found |= {tuple(sorted(p)) for p in zip(order[i].tolist(), order[j].tolist(), strict=True)}
        assert found == want


def test_passes_only_change_the_order_of_bits():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)
    for first in range(6):
        turned = S._rotate(keys, first)
        assert (np.bitwise_count(turned) == np.bitwise_count(keys)).all()
        start, size = S._FROM[first], S._BLOCKS[first]
        assert (turned >> np.uint64(64 - size) == keys >> np.uint64(64 - start - size) & np.uint64((1 << size) - 1)).all()


def test_replication_does_not_follow_the_input():
    """To how many buckets a print is sent, on average, over all passes."""

    def copies(rows):
        top = S.depth_of(rows)
        return sum((len(S.reach(top, S.MAX_BITS, first)) + 1) / 2 for first in range(6))

    assert [copies(10**k) for k in (0, 3, 5, 6, 7, 8, 9)] == [15, 15, 15, 21, 30, 36, 36]
    assert S.depth_of(10**9) == 10
    for rows in (10**5, 10**7):
        assert rows / (1 << S.depth_of(rows)) <= max(S.BUCKET_ROWS, rows / 8)


@pytest.mark.parametrize("top", [3, 12])
def test_edges_of_skewed_prints(spark, top):
    """Half of the prints share their first bits, and a third of all is one cluster."""
    rng = np.random.default_rng(top)
    a = rng.integers(0, 1 << 62, 1500).astype(np.uint64)
    a[:700] = (a[:700] & np.uint64((1 << 40) - 1)) | np.uint64(0x5A5A5A << 40)
    a[1000:] = a[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    b = rng.integers(0, 1 << 62, 1500).astype(np.uint64)
    b[1000:] = b[0]
    keys = {(int(x), int(y)): i for i, (x, y) in reversed(list(enumerate(zip(a, b, strict=True))))}
    rows = [(i, int(np.uint64(x).view(np.int64)), int(np.uint64(y).view(np.int64))) for (x, y), i in keys.items()]
    got = S.near_edges(spark.createDataFrame(rows, "id long, a long, b long"), top=top).collect()
    index = {r[0]: k for k, r in enumerate(rows)}
    pa_, pb = np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint64)
    near = (np.bitwise_count(pa_[:, None] ^ pa_[None, :]) <= S.MAX_BITS) & (np.bitwise_count(pb[:, None] ^ pb[None, :]) <= S.MAX_PAIR_BITS)
    i, j = np.nonzero(np.triu(near, 1))
    assert len(i) > 1000
    want = S.forest(len(rows), i, j)
    made = S.forest(len(rows), np.array([index[r["u"]] for r in got]), np.array([index[r["v"]] for r in got]))
    assert (want == made).all()
    assert all(near[index[r["u"]], index[r["v"]]] or want[index[r["u"]]] == want[index[r["v"]]] for r in got)


def changed(rng, text, words):
    out = text.split(" ")
    for _ in range(words):
        out[rng.randrange(len(out))] = f"z{rng.randrange(999)}"
    return " ".join(out)


def corpus(rng, n=300):
    """Texts with their true group."""
    rows = []
    for g in range(n):
        text = prose(rng, rng.randint(60, 250), 20_000)
        rows += [(g, text)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            rows.append((g, rng.choice([text, changed(rng, text, 1), text.upper(), text + " More."])))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k][1], rows[k][0]) for i, k in enumerate(order)]


def test_groups_are_those_of_brute_force(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS)
    prints = {r["doc_id"]: (r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in S.fingerprints(docs).collect()}
    label = {i: i for i in prints}
    ids = sorted(prints)
    edges = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if (prints[x][0] ^ prints[y][0]).bit_count() <= S.MAX_BITS and (prints[x][1] ^ prints[y][1]).bit_count() <= S.MAX_PAIR_BITS]
    moved = True
    while moved:
        moved = False
        for x, y in edges:
            low = min(label[x], label[y])
            if label[x] != low or label[y] != low:
                label[x] = label[y] = low
                moved = True
    got = {r["doc_id"]: r["group_id"] for r in S.near_groups(docs).collect()}
    assert all(got.get(i, i) == label[i] for i in ids)
    # and nearly all true copies are found, with hardly any false ones
    true = {i: g for i, _, g in rows}
    pairs = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if true[x] == true[y]]
    assert sum(label[x] == label[y] for x, y in pairs) >= 0.95 * len(pairs)
    assert all(true[i] == true[label[i]] for i in ids)


def test_one_of_each_group_stays(spark):
    rows = corpus(random.Random(5), 60)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS)
    kept = {r["doc_id"] for r in S.drop_near_copies(docs).collect()}
    groups = {r["doc_id"]: r["group_id"] for r in S.near_groups(docs).collect()}
    assert kept == {i for i, _, _ in rows if groups.get(i, i) == i}


def test_awkward(spark):
    docs = awkward(spark)
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert ids.count(0) == 1 and ids.count(1) == 1 and ids.count(None) == 2
    assert {100, 101, 102, 103, 104} <= set(ids)
    assert all(r["TOKENS"] == 7 for r in rows)
    again = S.near_groups(docs).where("doc_id = 0").first()
    assert again is None or again["copies"] == 3
    assert S.near_groups(empty(spark)).count() == 0
    assert S.drop_near_copies(empty(spark)).count() == 0


def test_forest():
    assert S.forest(5, np.array([4, 1]), np.array([3, 3])).tolist() == [0, 1, 2, 1, 1]
