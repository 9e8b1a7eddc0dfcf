import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainsift.operators.postings import candidates, forward_predicate, postings
from grainsift.functions.ngrams import pairs
from grainsift.operators.verify import MARK, PIECE, _marker, regex_hits
import grainsift.plans.regex as regex_plans
from grainsift.plans.regex import RegexError, compile_regex


@pytest.mark.parametrize(
    ("pattern", "kind", "branches"),
    [("fn main", "union", 1), ("foo|bar", "union", 2), ("[a-z]+", "all", 0), (r"(?m)^func\s+New[A-Za-z0-9_]*", "union", 1), (r"\b\B", "all", 0), ("[a&&b]", "never", 0), ("x", "all", 0), ("foo|b", "all", 0)],
)
def test_plans(pattern, kind, branches):
    plan = compile_regex(pattern).plan
    assert (plan.kind, len(plan.branches)) == (kind, branches)


@pytest.mark.parametrize("pattern", ["(", ")", "[a", "a{x}", "*a", "(?=a)", "(?<!a)", r"\1", r"\q", "[z-a]", "(?P<n>a)(?P<n>b)", "a{3,2}"])
def test_invalid(pattern):
    with pytest.raises(RegexError, match="invalid regex"):
        compile_regex(pattern)


def test_empty():
    with pytest.raises(ValueError, match="empty search text"):
        compile_regex("")


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [("(?P<n>ab|cd)ef", {"abef", "cdef"}), ("a{2,3}b", {"aa"}), ("colou?r", {"color", "colour"}), ("[ab]c", {"ac", "bc"}), ("(?i)k", {"k", "K", "K"}), ("abc.*x", {"abc"}), ("x*y", {"x", "y"})],
)
def test_literals(pattern, literals):
    assert set(compile_regex(pattern).literals) == literals


CASES = [
    ("foo|bar", "alpha\nfoo\n", [(2, "foo")]),
    (r"[a-z]{3}\d{2}", "abc12\nzzz\n", [(1, "abc12")]),
    ("foo", "foo foo foo\n", [(1, "foo foo foo")]),
    (r"\b\B", "abc\n", []),
    ("foo", "foo foo\r\nbar\nfoo\n", [(1, "foo foo"), (3, "foo")]),
    (r"foo\s+bar", "foo\nbar\nfoo bar\n", [(1, "foo"), (3, "foo bar")]),
    ("x*", "abc\n", [(1, "abc"), (2, "")]),
    (r"\n", "a\nb\n", [(1, "a"), (2, "b")]),
    ("^foo", "x\nfoo", []),
    ("(?m)^foo", "x\nfoo", [(2, "foo")]),
    ("foo$", "foo\n", []),
    ("(?m)foo$", "foo\nfoo", [(1, "foo"), (2, "foo")]),
    ("a.b", "a\rb", [(1, "a\rb")]),
    ("a.b", "a\nb", []),
    ("(?s)a.b", "a\nb", [(1, "a")]),
    (r"\d", "٣", [(1, "٣")]),
    (r"(?-u)\d", "٣", []),
    (r"é\b", "é.", [(1, "é.")]),
    ("(?i)É", "é", [(1, "é")]),
    ("(?i)k", "K", [(1, "K")]),
    ("[[:alpha:]]+x", "abx", [(1, "abx")]),
    ("[^a]b", "ab\ncb", [(2, "cb")]),
    ("[a-z&&[^b]]c", "bc\nac", [(2, "ac")]),
    ("[a-c--b]z", "bz\ncz", [(2, "cz")]),
    ("a++b", "aab", [(1, "aab")]),
    (r"\x{66}oo|bar", "foo\nbar", [(1, "foo"), (2, "bar")]),
    ("(?x) f o o # rest", "foo", [(1, "foo")]),
    ("$0", "a", []),
    ("a{2}", "aab", [(1, "aab")]),
]


@pytest.mark.parametrize(("pattern", "text", "expected"), CASES)
def test_hits(spark, pattern, text, expected):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["line_no"], r["line"]) for r in regex_hits(docs, pattern).where("doc_id = 1").collect())
    assert got == expected


def test_candidates_never_miss(spark):
    rng = random.Random(3)
    words = ["alpha", "beta_gamma", "needle", "fn main", "x1", "login("]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) + rng.choice(["", "\n", "zz"]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    lists = postings(pairs(docs), 50).cache()
    state = docs.join(pairs(docs).groupBy("doc_id").agg({"hash": "collect_set"}).withColumnRenamed("collect_set(hash)", "hashes"), "doc_id")
    for pattern in ["needle", "fn main|login\\(", "beta_\\w+", "zzqq", "[a&&b]", "x*"]:
        regex = compile_regex(pattern)
        found = {r["doc_id"] for r in candidates(lists, regex.plan, docs).collect()}
        assert found == {r["doc_id"] for r in candidates(lists.groupBy("hash").agg(F.flatten(F.collect_list("doc_ids")).alias("doc_ids")), regex.plan, docs).collect()}
        truth = {i for i, t in enumerate(texts) if pattern != "[a&&b]" and re.search(pattern, t)}
        assert truth <= found
        if regex.plan.kind == "union":
            assert found == {r["doc_id"] for r in state.where(forward_predicate(state["hashes"], regex.plan)).collect()}


@pytest.mark.parametrize(
    ("pattern", "engine"),
    [("foo|bar", "native"), (r"[a-z]{3}\d{2}", "native"), ("(?:ab){3}c", "native"), ("(?:ab|ba|a)*c", "linear"), ("(foo|bar)+x", "linear"), (r"\w+@", "linear"), ("x*", "linear"), (r"\bfoo.*", "native"), (r"(?:\ba|b)+c", "guarded")],
)
def test_engines(pattern, engine):
    assert compile_regex(pattern).engine == engine


@pytest.mark.parametrize("java", [r"[\p{IsAlphabetic}]", r"[\w]", r"[^\p{IsWhite_Space}]", r"[\p{IsGreek}&&[^\p{Lu}]]", r"[^\n]", r"[\x{41}-\x{5A}\-\]]", r"(?iu:[\p{Lu}])"])
def test_ranges_hold_what_the_class_holds(spark, java):
    chars = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x2028, 0x1F600, 0x10FFFF]]
    docs = spark.createDataFrame([(c,) for c in chars], "c string")
    native = {r["c"] for r in docs.where(F.col("c").rlike("(?U)\\A" + java + "\\z")).collect()}


    import pyarrow as pa
    import pyarrow.compute as pc

    got = pc.match_substring_regex(pa.array(chars), r"\A" + regex_plans._ranges(java) + r"\z").to_pylist()
    assert {c for c, g in zip(chars, got, strict=True) if g} == native


LONG = "ab" * 250_000 + "a"


@pytest.mark.parametrize(
    ("pattern", "text", "expected"),
    [("(?:ab|ba|a)*c", LONG + "c", 1), ("(?:ab|ba|a)*c", LONG, 0), ("(foo|bar)+x", "foobar" * 100_000 + "x", 1), ("(a|a)*b", "a" * 200_000, 0), (r"(?:a+b?)+\b!", LONG + "!", 1), (r"(?:a+b?)+\b!", LONG[:2000] + "é!", 0), ("[a-z]*1", "a" * 1_000_000, 0), (r"(?:\w|é)+\bz", "é" * 3000 + " z", 0)],
)
def test_long_texts_neither_overflow_nor_hang(spark, pattern, text, expected):
    docs = spark.createDataFrame([(1, "q\n" + text), (2, None)], "doc_id long, text string")
    got = [(r["line_no"], r["line"]) for r in regex_hits(docs, pattern).collect()]
    assert got == [(2, text)] * expected


def test_no_empty_match_behind_a_match(spark):
    docs = spark.createDataFrame([(1, "ba\nc")], "doc_id long, text string")
    # a* matches nothing before b, then a, then nothing at the line end is not taken again
    assert [r["line_no"] for r in regex_hits(docs, r"a\n|(?:)c|a*$").collect()] == [1, 2]


def test_texts_are_marked_by_pieces():
    texts = [f"{k} " + "ab, " * 25_000 + "ending" for k in range(40)] + [None, "", "no", "ab " * PIECE + "king"]
    batch = pa.record_batch([pa.array(range(44)), pa.array(texts)], ["c0", "text"])
    parts = list(_marker(compile_regex("(?:[a-z]+ |[a-z]+, )+[a-z]+ing").linear, None)(iter([batch])))
    assert max(p.nbytes for p in parts[:-1]) < 3 * PIECE  # the whole batch was marked at once
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["c0"] for r in rows] == [*range(40), 43]
    assert all(r["marked"] == r["text"].replace("ab", MARK + "ab", 1) for r in rows)
