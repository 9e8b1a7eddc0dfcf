import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from fixtures import DOCS, awkward, empty
from hypothesis import assume, given
from hypothesis import strategies as st

from grainsift.llm.mixing import entropy, mix_sources, part, solve

sizes = st.lists(st.integers(1, 10**9), min_size=2, max_size=12)


@given(sizes, st.floats(0.3, 1.0))
def test_entropy_target(tokens, share):
    got = solve(tokens, share, None)
    target = share * math.log(len(tokens))
    assert sum(got.weights) == pytest.approx(1)
    assert entropy(got.weights) >= target - 1e-6
    if got.exponent < 1:  # no flatter than asked
        assert entropy(got.weights) == pytest.approx(target, abs=1e-6)


@given(sizes, st.floats(1.01, 4))
def test_repetition_limit(tokens, limit):
    assume(max(tokens) > 1)
    got = solve(tokens, 1.0, limit)
    epochs = [w * got.budget / t for w, t in zip(got.weights, tokens, strict=True)]
    assert max(epochs) <= limit * (1 + 1e-6) + 1 / min(tokens)
    assert min(epochs) >= 1 - 1e-6 - 1 / min(tokens)


def brute(rows, budget, entropy_share, limit, seed=17):
    groups = defaultdict(list)
    for i, text, s in rows:
        groups[s].append((i, len((text or "").split())))
    names = sorted(groups, key=lambda s: (s is not None, s))
    totals = [sum(n for _, n in groups[s]) for s in names]
    found = solve(totals, entropy_share, limit, budget)
    out = Counter()
    for s, total, w in zip(names, totals, found.weights, strict=True):
        share = part(w, found.budget)
        epochs, rest = divmod(share, total) if total else (1, 0)
        for i, _ in groups[s]:
            out[i] += epochs
        order = defaultdict(list)
        for i, n in groups[s]:
            order[hashlib.md5(f"{'null' if i is None else i}:-1:{seed}".encode()).hexdigest()].append((i, n))
        used = 0
        for k in sorted(order):
            used += sum(n for _, n in order[k])
            if used > rest or not rest:
                break
            for i, _ in order[k]:
                out[i] += 1
    return Counter({i: n for i, n in out.items() if n})


@pytest.mark.parametrize(("budget", "share", "limit"), [(None, 0.98, 1.5), (None, 0.9, None), (5000, 0.95, None), (200_000, None, None), (300, 1.0, None)])
def test_brute_force(spark, budget, share, limit):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 5, 40, 90]), rng.choices(["hot", "b", "c", None], [20, 3, 2, 1])[0]) for i in range(700)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    got = mix_sources(docs, share, limit, budget, report=True).collect()
    assert Counter(r["doc_id"] for r in got) == brute(rows, budget, share, limit)
    for i, epochs in ((r["doc_id"], r["epoch"]) for r in got):
        assert epochs >= 0, i
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    if budget:
        # never above the budget, and not below it by more than a document a source
        used = sum(len(r["text"].split()) for r in got)
        assert budget - 4 * 91 <= used <= budget


def test_whole_corpus_is_seen_without_a_budget(spark):
    rows = [(i, "w " * 20, "hot" if i % 4 else "b") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    seen = Counter(r["doc_id"] for r in mix_sources(docs).collect())
    assert set(seen) == set(range(400))
    assert max(seen.values()) == 2


def test_awkward(spark):
    docs = awkward(spark)
    got = mix_sources(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()}
    assert mix_sources(empty(spark)).count() == 0
    blank = docs.where("doc_id in (100, 102)")
    assert mix_sources(blank).count() == 2


def test_what_cannot_be_reached_is_told():
    with pytest.raises(ValueError, match="at most 1.0 epochs"):
        solve([10, 1000, 5], 0.98, 1.0, 5000)
    found = solve([10, 1000, 5], 0.98, 1.5)
    assert found.entropy_share < 0.98 and found.epochs <= 1.5 + 1e-6  # the limit comes first
    free = solve([10, 1000, 5], 0.98, None)
    assert free.entropy_share >= 0.98 and free.epochs > 1.5
