import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainsift.functions.kernels import plain_hashes, short_hashes, span_hashes, unmix
from grainsift.functions.ngrams import FEW, PIECE, SHARED, STEP, _fnv_ranges, covering, fnv1a32, fnv1a64_hex, forward_tokens, index_hash, index_tokens, ngram_rows, ngrams, pairs, partial_postings, spans, token_counts


def brute(b: bytes) -> list[bytes]:
    w = [zlib.crc32(b[i : i + 2]) for i in range(len(b) - 1)]
    return [b[i : j + 1] for i in range(len(b)) for j in range(i + 1, len(b)) if j <= i + 2 or min(w[i], w[j - 1]) > max(w[i + 1 : j - 1])]


text = st.binary(max_size=40) | st.text("ab c1", max_size=60).map(str.encode)


@given(text)
def test_tokens_are_those_of_the_definition(b):
    assert sorted(ngrams(b)) == sorted(brute(b))


@given(st.lists(text, min_size=1, max_size=12))
def test_a_batch_is_its_texts(texts):
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    starts, ends = spans(raw, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    for k, t in enumerate(texts):
        assert sorted(bytes(raw[a:b]) for a, b in zip(starts[owner == k], ends[owner == k], strict=True)) == sorted(brute(t))


@given(text, text, text)
def test_covering_tiles_are_tokens_of_any_text_around(before, literal, after):
    tiles = covering(literal)
    assert b"".join(tiles) == literal
    assert {t for t in tiles if len(t) > 1} <= set(ngrams(before + literal + after))


@pytest.mark.parametrize(
    ("source", "count", "tiles"),
    [("a", 0, ["a"]), ("ab", 1, ["ab"]), ("foo", 3, ["foo"]), ("aaaa", 5, ["aaa", "a"]), ("hello", 8, ["hell", "o"]), ("login(", 11, ["log", "in("]), ("token_3_4", 18, ["toke", "n_3", "_4"])],
)
def test_golden(source, count, tiles):
    assert len(ngrams(source.encode())) == count
    assert [t.decode() for t in covering(source.encode())] == tiles


def test_hashes():
    assert [fnv1a32(x) for x in (b"", b"a", b"foo", b"needle")] == [2166136261, 3826002220, 2851307223, 2293321154]
    assert len(fnv1a64_hex("/tmp")) == 16
    assert index_hash(b"foo") == index_hash(b"foo") != index_hash(b"fop")


def test_rows_and_pairs(spark):
    docs = spark.createDataFrame([(1, "foo foo"), (2, ""), (3, None), (4, "é")], "doc_id long, text string")
    rows = ngram_rows(docs).collect()
    assert {(r["doc_id"], r["start"], bytes(r["ngram"])) for r in rows if r["doc_id"] == 4} == {(4, 0, "é".encode())}
    assert all(r["hash"] == fnv1a32(bytes(r["ngram"])) for r in rows)
    found = pairs(docs).collect()
    assert len(found) == len(set(found))
    assert {r["doc_id"] for r in found} == {1, 4}
    assert index_hash(b"foo") in {r["hash"] for r in found}


@settings(max_examples=30)
@given(st.binary(min_size=2, max_size=300))
def test_length_limit_keeps_shorter_tokens(b):
    raw = np.frombuffer(b, np.uint8)
    starts, ends = spans(raw, np.array([0, len(b)]), 20)
    assert sorted(zip(starts, ends, strict=True)) == sorted((a, e) for a, e in zip(*spans(raw, np.array([0, len(b)])), strict=True) if e - a <= 20)


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.data())
def test_hashes_of_ranges_of_any_length(b, data):
    ends = st.integers(0, len(b))
    ranges = data.draw(st.lists(st.tuples(ends, ends).map(sorted), min_size=1, max_size=FEW * 2))
    starts, stops = np.array(ranges).T
    starts = np.minimum(starts, len(b) - 1)
    got = _fnv_ranges(np.frombuffer(b, np.uint8), starts, np.maximum(stops, starts))
    assert got.tolist() == [fnv1a32(b[x : max(x, y)]) for x, y in zip(starts, stops, strict=True)]


def test_many_and_long_ranges_take_linear_time():
    raw = np.frombuffer(random.Random(3).randbytes(3 << 20), np.uint8)
    short = np.arange(len(raw) - SHARED)
    starts, ends = np.r_[5, short], np.r_[len(raw), short + 3]
    began = time.process_time()
    h = _fnv_ranges(raw, starts, ends)
    assert time.process_time() - began < 20  # a step over all ranges for each byte of the longest took hours
    assert [int(x) for x in h[:2]] == [fnv1a32(raw[5:].tobytes()), fnv1a32(raw[:3].tobytes())]


def test_tokens_of_a_megabyte_take_little_memory():
    raw = np.frombuffer(random.Random(4).randbytes(PIECE), np.uint8)
    tracemalloc.start()
    index_tokens(raw, np.array([0, len(raw)]), np.array([5]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # pieces of a megabyte took over 400 MB in each worker


@settings(deadline=None)
@given(st.lists(text, min_size=1, max_size=12), st.data())
def test_index_tokens_are_those_of_the_definition(texts, data):
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    want = sorted((index_hash(g), k) for k, t in enumerate(texts) for g in brute(t))
    some = data.draw(st.sets(st.sampled_from([h for h, _ in want] or [0]))) | {5}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("grainsift.functions.ngrams.STEP", data.draw(st.sampled_from([1, 50, STEP])))
        assert sorted(zip(*(c.tolist() for c in index_tokens(raw, offsets, None)), strict=True)) == want
        found = index_tokens(raw, offsets, np.array(sorted(some), np.int64))
    assert sorted(zip(*(c.tolist() for c in found), strict=True)) == [x for x in want if x[0] in some]


def test_tokens_of_many_texts_stay_in_the_cache():
    raw, offsets = np.frombuffer(random.Random(5).randbytes(PIECE), np.uint8), np.arange(0, PIECE + 1, 1 << 12)
    tracemalloc.start()
    index_tokens(raw, offsets, np.array([5]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * PIECE  # arrays of a whole piece: 133 bytes a byte of text, and twice the time


def test_hashes_before_mixing():
    raw = np.frombuffer(random.Random(6).randbytes(500), np.uint8)
    for n, h in zip((2, 3), short_hashes(raw), strict=True):
        starts = np.arange(len(raw) + 1 - n)
        assert np.array_equal(h, plain_hashes(raw, starts, starts + n))
        assert np.array_equal(unmix(span_hashes(raw, starts, starts + n)), h)


def test_token_counts_add_up_over_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "foo foo"), (1, "foo"), (2, ""), (None, "ab"), (None, "ab")], "doc_id long, text string")
    found = {(r["doc_id"], r["hash"]): r["times"] for r in token_counts(docs).collect()}
    assert found[1, fnv1a32(b"foo")] == 3
    assert found[None, fnv1a32(b"ab")] == 2
    assert {(r["doc_id"], r["hash"]): r["times"] for r in token_counts(docs.where("text = 'foo'")).collect()} == {(1, fnv1a32(g)): 1 for g in brute(b"foo")}


def test_forward_tokens_are_rows_of_their_texts(spark):
    docs = spark.createDataFrame([(1, "a", "foo foo"), (1, "b", "bar foo"), (2, "c", ""), (3, "d", None)], "doc_id long, path string, text string")
    forward = forward_tokens(docs, ["doc_id", "path"])
    plan = forward._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # a set of all hashes was gathered by a shuffle
    want = {p: sorted({index_hash(g) for g in ngrams((t or "").encode())}) for _, p, t in docs.collect()}
    assert {r["path"]: r["hashes"] for r in forward.collect()} == want
    some = [index_hash(b"foo"), index_hash(b"ba"), 5]
    assert {r["path"]: r["hashes"] for r in forward_tokens(docs, ["doc_id", "path"], wanted=some).collect()} == {p: sorted(set(hs) & set(some)) for p, hs in want.items()}


def test_lists_of_wanted_hashes(spark):
    docs = spark.createDataFrame([(k, f"foo {k} bar") for k in range(30)] + [(40, "")], "doc_id long, text string")
    wanted = [index_hash(b"foo"), index_hash(b"7 b"), 12345]

    def lists(**more):
        found = partial_postings(docs, docs_per_shard=10, **more).collect()
        return sorted((r["hash"], r["shard_id"], d) for r in found for d in r["doc_ids"])

    assert lists(wanted=wanted) == [x for x in lists() if x[0] in wanted]
    assert len(lists(wanted=wanted)) == 33
    assert lists(wanted=[]) == []
