import json
import os

import pytest

from grainsift.cli import main, poll
from grainsift.engine import Engine, LiveSearch, append_errors, indexed_search
from grainsift.operators.postings import array_difference, candidates, manifest_errors, text_postings, varint_size
from grainsift.operators.verify import highlight_spans, sanitize
from grainsift.plans.regex import compile_regex
from grainsift.sources.files import crawl
from grainsift.sources.index import check_manifest, index_path


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    files = {
        "src/a.txt": b"alpha\nfoo_123\ncommon token\n", "src/b.txt": b"beta\nbar_999\ncommon token\n", "docs/c.md": b"gamma\nfoo_888 and bar_777\n", "docs/d.md": b"no hits here\n",
        "src/__init__.py": b"foo_000\n", ".hidden": b"foo_111\n", "bin.dat": b"foo_222\0", "late.dat": b"a" * 9000 + b"\0foo_333", "bad.txt": b"foo_444 \xff\xfe", "skip/x.txt": b"foo_555\n",
        ".gitignore": b"skip/\n*.log\n", "n.log": b"foo_666\n", "src/lib.rs": b"pub fn login() {}\n",
    }
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "home"))


def lines(result, root):
    return sorted((os.path.relpath(r["path"], root), r["line_no"], r["line"]) for r in result.hits.collect())


def test_crawl(tree):
    assert [os.path.relpath(p, tree) for p in crawl(str(tree))] == ["bad.txt", "bin.dat", "docs/c.md", "docs/d.md", "late.dat", "src/__init__.py", "src/a.txt", "src/b.txt", "src/lib.rs"]
    assert len(crawl(str(tree), ignore_rules=False)) == 13


def test_query(tree, engine):
    index = engine.index(str(tree), docs_per_shard=3)
    assert index.doc_count == 8  # without the binary file
    assert len(index.manifest["shards"]) > 1
    root = str(tree)
    assert lines(engine.query(root, "common token"), root) == [("src/a.txt", 3, "common token"), ("src/b.txt", 3, "common token")]
    result = engine.query(root, r"foo_\d{3}|bar_\d{3}")
    found = [(p, n) for p, n, _ in lines(result, root)]
    assert found == [("docs/c.md", 2), ("late.dat", 1), ("src/__init__.py", 1), ("src/a.txt", 2), ("src/b.txt", 2)]
    assert [os.path.basename(r["path"]) for r in result.errors.collect()] == ["bad.txt"]
    assert engine.printed(root, r"login\(") == ["./src/lib.rs", "1:pub fn login() {}"]
    assert lines(engine.query(root, "definitely_not_present_123"), root) == []
    # candidates are of the index, contents of the files now
    (tree / "src/a.txt").unlink()
    result = engine.query(root, "foo_1")
    assert lines(result, root) == []
    assert [r["error"].split(":")[0] for r in result.errors.collect()] == ["FileNotFoundError"]


def test_search_and_caps(tree, engine):
    engine.index(str(tree))
    rows, stats = engine.search(str(tree), "common", max_results=3)
    assert [r["kind"] for r in rows] == ["header", "hit", "header"]
    assert stats["backend"] == "index" and stats["hits"] == 1
    assert engine.search(str(tree), "") == ([], {"backend": "idle"})
    assert engine.search(str(tree), "(")[1]["backend"] == "error"


def test_errors(tree, engine):
    with pytest.raises(ValueError, match="invalid regex"):
        engine.query(str(tree), "(")
    with pytest.raises(FileNotFoundError, match="index"):
        engine.query(str(tree), "foo")


def test_versions(tree, engine):
    assert engine.index(str(tree)).version == 1
    (tree / "new.txt").write_text("needle\n")
    assert engine.index(str(tree)).version == 2
    assert lines(engine.query(str(tree), "needle"), str(tree)) == [("new.txt", 1, "needle")]


def test_empty_tree(tmp_path, engine):
    (tmp_path / "none").mkdir()
    assert engine.index(str(tmp_path / "none")).doc_count == 0
    assert lines(engine.query(str(tmp_path / "none"), "foo"), str(tmp_path)) == []


def test_command_line(tree, tmp_path, spark, capsys):
    home = str(tmp_path / "h")
    assert main(["--home", home, "query", "(", "-p", str(tree)], spark) == 1
    assert "invalid regex" in capsys.readouterr().err
    assert main(["--home", home, "query", "foo", "-p", str(tree)], spark) == 1
    assert "index" in capsys.readouterr().err
    assert main(["--home", home, "index", str(tree)], spark) == 0
    assert main(["--home", home, "query", "common token", "-p", str(tree)], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["./src/a.txt", "3:common token", "", "./src/b.txt", "3:common token"]
    with pytest.raises(SystemExit):
        main(["--help"])


def test_poll(tmp_path):
    seen = {}
    (tmp_path / "a").write_text("x")
    assert poll(str(tmp_path), seen) == [(str(tmp_path / "a"), "upsert")]
    assert poll(str(tmp_path), seen) == []
    (tmp_path / "a").unlink()
    assert poll(str(tmp_path), seen) == [(str(tmp_path / "a"), "delete")]


def test_manifest(spark):
    good = {"format_version": 1, "doc_count": 3, "shards": [{"shard_id": 0, "doc_base": 0, "doc_count": 2}, {"shard_id": 1, "doc_base": 2, "doc_count": 1}]}
    check_manifest(good)
    for change in ({"doc_count": 4}, {"format_version": 9}, {"shards": [{"shard_id": 0, "doc_base": 1, "doc_count": 3}]}):
        with pytest.raises(ValueError):
            check_manifest(json.loads(json.dumps(good)) | change)
    table = spark.createDataFrame([(0, 0, 2), (1, 2, 1)], "shard_id long, doc_base long, doc_count long")
    assert manifest_errors(table, 3).count() == 0
    assert [r["error"] for r in manifest_errors(table, 4).collect()] == ["total"]
    assert index_path("/h", "/tmp").startswith("/h/indexes/")


def test_small_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\tb\x07c", "foo bar foo", [1, 2, 5], [2, 3, 5, 9])], "a string, b string, c array<long>, d array<long>")
    row = df.select(sanitize(F.col("a")).alias("a"), highlight_spans(F.col("b"), "foo").alias("b"), array_difference(F.col("c"), F.col("d")).alias("d")).first()
    assert row["a"] == "a    b c"
    assert [(s["text"], s["hit"]) for s in row["b"]] == [("foo", True), (" bar ", False), ("foo", True)]
    assert (row["d"]["removed"], row["d"]["added"]) == ([1], [3, 9])
    sizes = spark.createDataFrame([(v,) for v in (0, 1, 127, 128, 16384, 4294967295)], "v long").select(varint_size(F.col("v")).alias("n"))
    assert [r["n"] for r in sizes.collect()] == [1, 1, 1, 2, 3, 5]


def test_only_the_newest_search_is_delivered(tree, engine):
    engine.index(str(tree))
    got = []
    live = LiveSearch(engine, str(tree), lambda *x: got.append(x), rest_s=0.3)
    threads = [live.submit(p) for p in ("f", "fo", "common token")]
    for t in threads:
        t.join(120)
    assert [(n, stats["backend"], stats["hits"]) for n, _, stats in got] == [(3, "index", 2)]


def test_error_log(spark, tmp_path):
    errors = spark.createDataFrame([(1, "p", "bad")], "doc_id long, path string, error string")
    append_errors(errors, str(tmp_path / "log"))
    append_errors(errors, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_indexed_search_matches_candidates_only(spark, tmp_path):
    from grainsift.engine import id_ranges, indexed_search
    from grainsift.operators.verify import regex_hits
    from grainsift.sources.index import open_index, write_index

    assert id_ranges([5, 6, 7, 100, 101, 9000], 3) == [(5, 7), (100, 101), (9000, 9000)]
    assert id_ranges([5, 6, 7, 100, 101, 9000], 2) == [(5, 101), (9000, 9000)]
    docs = spark.createDataFrame([(i, "p", f"text {i} needle_{i % 50} tail\nfoo_{i}") for i in range(3000)], "doc_id long, path string, text string")
    write_index(docs, str(tmp_path / "ix"), "text", keep_text=True)
    index = open_index(spark, str(tmp_path / "ix"))
    for pattern in ("needle_7 ", "foo_299[0-9]", "needle_1|zzz", "nowhere_x"):
        want = sorted(map(tuple, regex_hits(docs, pattern).collect()))
        for known in (4096, 0):  # ids pushed into the scan, and a join
            assert sorted(map(tuple, indexed_search(index.docs, index.postings, pattern, known=known).collect())) == want
    few = indexed_search(index.docs, index.postings, "foo_299[0-9]")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(doc_id,2999)" in plan.replace("`", "")
    many = indexed_search(index.docs, index.postings, "needle_1|zzz", known=0)
    logical = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in logical.split("Join LeftSemi")[0] and "RLIKE" not in logical.split("Join LeftSemi")[1]


@pytest.mark.parametrize("known", [1, 4096])
def test_lists_of_one_search_are_made_once(spark, known):
    docs = spark.createDataFrame([(k, f"a\nfoo {k}" if k % 2 else "bar") for k in range(30)], "doc_id long, text string")
    hits = indexed_search(docs, text_postings(docs, 10), "foo", known=known)
    assert "MapInArrow" not in hits._jdf.queryExecution().optimizedPlan().toString()  # the texts' tokens were found again for the join
    if known == 1:
        assert "strategy=broadcast" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, hits.collect())) == [(k, 2, f"foo {k}") for k in range(1, 30, 2)]


@pytest.mark.parametrize("pattern", ["foo", "foo bar|ba[rz]9"])
def test_candidates_of_lists_made_for_one_search(spark, pattern):
    plan = compile_regex(pattern).plan
    docs = spark.createDataFrame([(k, f"foo bar{k}" if k % 3 else "ba") for k in range(40)], "doc_id long, text string")
    want = sorted(r["doc_id"] for r in candidates(text_postings(docs, 10), plan, docs).collect())
    assert want
    assert sorted(r["doc_id"] for r in candidates(text_postings(docs, 10, wanted=plan.hashes), plan, docs).collect()) == want
