import random

import pytest
from fixtures import DOCS, awkward, empty, prose
from hypothesis import given
from hypothesis import strategies as st

from grainsift.llm import automaton as A


@given(st.lists(st.lists(st.integers(0, 2), max_size=15), max_size=4), st.lists(st.integers(0, 2), max_size=25), st.integers(1, 4))
def test_spans_of_an_automaton(references, sequence, least):
    a = A.Automaton()
    for r in references:
        a.add(r)
    bad = set()
    for i in range(len(sequence) - least + 1):
        if any(r[k : k + least] == sequence[i : i + least] for r in references for k in range(len(r) - least + 1)):
            bad |= set(range(i, i + least))
    assert {k for x, y in a.spans(sequence, least) for k in range(x, y)} == bad


def brute(rows, span):
    """Words in runs that an earlier document holds."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        ids, starts = A._word_ids(text)
        bad = [False] * len(ids)
        runs = [tuple(ids[i : i + span]) for i in range(len(ids) - span + 1)]
        for i, run in enumerate(runs):
            if seen.get(run, doc) < doc:
                bad[i : i + span] = [True] * span
        for run in runs:
            seen.setdefault(run, doc)
        data = text.encode()
        kept = data[: starts[0]] if ids else data
        out[doc] = (kept + b"".join(data[starts[i] : starts[i + 1]] for i in range(len(ids)) if not bad[i])).decode()
    return out


@pytest.mark.parametrize(("span", "k"), [(8, 4), (50, 25)])
def test_brute_force(spark, span, k):
    rng = random.Random(span)
    shared = [prose(rng, rng.randint(span - 2, 3 * span), 9000) for _ in range(12)]
    rows = []
    for i in range(150):
        text = prose(rng, rng.randint(0, 4 * span), 9000)
        for _ in range(rng.choice([0, 1, 1, 2])):
            part = rng.choice(shared).split(" ")
            at = rng.randrange(len(part) // 2 + 1)
            part = " ".join(part[at : at + rng.randint(1, 3 * span)])
            text = rng.choice([f"{text} {part}", f"{part} {text}", f"{text} {part.upper()} {prose(rng, 20)}"])
        rows.append((rng.randrange(10**6) * 200 + i, text))
    rows += [(5, rows[0][1]), (10**9, rows[3][1]), (10**9 + 1, rows[3][1]), (7, "ab " * 300), (8, "ab " * 200)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    got = {r["doc_id"]: r["text"] for r in A.remove_shared(docs, span, k).collect()}
    want = brute(rows, span)
    assert got == want
    changed = A.remove_shared(docs, span, k, changed_only=True).collect()
    assert {r["doc_id"]: r["text"] for r in changed} == {i: want[i] for i, t in rows if want[i] != t}
    # with some anchors hot, or all of them: the same, to the number of runs
    for hot in (6, 0):
        again = A.remove_shared(docs, span, k, changed_only=True, hot_docs=hot).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, changed))


def test_recombined_passages(spark):
    """X W Y, then X Y, then a part across the seam of X and Y."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        x, w, y = (prose(rng, rng.randint(60, 90), 10**6) for _ in range(3))
        rows += [(10 * i, f"{x} {w} {y}"), (10 * i + 1, f"{x} {y}"), (10 * i + 2, " ".join([*x.split()[-40:], *y.split()[:20]]))]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)
    got = {r["doc_id"]: r["text"] for r in A.remove_shared(docs).collect()}
    want = brute(rows, A.MIN_WORDS)
    assert got == want
    assert all(want[10 * i + 2] == "" for i in range(60))


def test_awkward(spark):
    docs = awkward(spark)
    rows = A.remove_shared(docs)
    assert rows.columns == docs.columns
    before, after = docs.collect(), rows.collect()

    def key(r):
        return str(tuple(r))

    assert len(after) == len(before)
    # repeated rows and null ids are never matched, so all stays
    assert sorted(map(key, after)) == sorted(map(key, before))
    assert A.remove_shared(empty(spark)).count() == 0
    # the long text again, under a later id
    long = docs.where("doc_id = 104").selectExpr("999 doc_id", "text", "lang", "source", "n_chars", "epoch", "TOKENS", "gone", "spans", "keep")
    got = A.remove_shared(docs.unionByName(long)).where("doc_id = 999").first()
    assert got["text"] == ""


def test_given_reference(spark):
    rng = random.Random(1)
    passage, other = prose(rng, 60), prose(rng, 55)
    docs = spark.createDataFrame([(1, f"Before. {passage} After."), (2, "short"), (3, None), (4, ""), (5, f"{other} {passage}")], "doc_id long, text string")
    reference = spark.createDataFrame([(passage,), (other,), (None,), ("",)], "text string")
    got = {r["doc_id"]: r["text"] for r in A.remove_reference(docs, reference, shard_words=50).collect()}
    assert got == {1: "Before. After.", 2: "short", 3: None, 4: "", 5: ""}
    assert A.remove_reference(docs, reference.limit(0)).count() == 5
    assert A.remove_reference(docs.limit(0), reference).count() == 0
    # parts of one automaton each, and rows without an id or twice
    twice = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) doc_id", "text"))
    many = A.remove_reference(twice, reference, shard_words=1, limit=1).collect()
    assert sorted((r["text"] or "", r["doc_id"] or 0) for r in many) == sorted([(t or "", i) for i, t in got.items()] * 2 + [(t or "", 0) for t in got.values()])
    noted = {r["doc_id"]: r["removed_spans"] for r in A.remove_reference(docs, reference, changed_only=True).collect()}
    assert noted == {1: 1, 5: 1}  # two passages side by side are one run


@pytest.mark.parametrize("span", [6, 50])
def test_reference_against_brute_force(spark, span):
    rng = random.Random(span)
    reference = [prose(rng, rng.randint(0, 4 * span), 3000) for _ in range(30)] + ["", "one"]
    rows = []
    for i in range(80):
        text = prose(rng, rng.randint(0, 100), 3000)
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(reference).split(" ")
            at = rng.randrange(len(part) // 2 + 1)
            text += " " + " ".join(part[at : at + rng.randint(1, 3 * span)])
        rows.append((i, text))
    runs = {tuple(ids[i : i + span]) for ids, _ in map(A._word_ids, reference) for i in range(len(ids) - span + 1)}
    want = {}
    for i, text in rows:
        ids, starts = A._word_ids(text)
        bad = [False] * len(ids)
        for k in range(len(ids) - span + 1):
            if tuple(ids[k : k + span]) in runs:
                bad[k : k + span] = [True] * span
        data = text.encode()
        want[i] = ((data[: starts[0]] if ids else data) + b"".join(data[starts[k] : starts[k + 1]] for k in range(len(ids)) if not bad[k])).decode()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in A.remove_reference(docs, spark.createDataFrame([(t,) for t in reference], "text string"), span, shard_words=150, limit=20_000).collect()}
    assert got == want
    assert sum(want[i] != t for i, t in rows) > 20


def test_flat_form():
    rng = random.Random(4)
    a = A.Automaton()
    for _ in range(20):
        a.add([rng.randrange(5) for _ in range(rng.randrange(40))])
    b = A.Automaton.of(a.flat())
    assert (a.next, a.link, a.length) == (b.next, b.link, b.length)
    assert A.Automaton.of(A.Automaton().flat()).next == [{}]
