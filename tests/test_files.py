import os

from grainsift.sources import files
from grainsift.sources.index import open_index, write_index


def made(root, names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x\n")


def test_ignore_patterns(tmp_path):
    names = ["a.log", "b.txt", "#note", "!bang", "dir/x1.tmp", "dir/x2.tmp", "dir/xa.tmp", "sub/a.log", "deep/a/b/c.txt", "star*.md", "starry.md", "r[1].c", "r1.c"]
    made(tmp_path, names)
    (tmp_path / ".gitignore").write_text("# a remark\n\\#note\n\\!bang\n/a.log\ndir/x[0-9].tmp\ndeep/**/c.txt\nstar\\*.md\nr\\[1].c\n")
    found = {os.path.relpath(p, tmp_path) for p in files.crawl(str(tmp_path))}
    assert found == {"b.txt", "dir/xa.tmp", "sub/a.log", "starry.md", "r1.c"}


def test_large_files_are_never_read(spark, tmp_path, monkeypatch):
    made(tmp_path, ["small.txt"])
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)  # no blocks on disk
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("small.txt", "large.bin", "gone")], "path string")
    got = {os.path.basename(r["path"]): (r["content"], r["size"], r["error"]) for r in files.read_paths(paths).collect()}
    assert got["small.txt"] == (bytearray(b"x\n"), 2, None)
    assert got["large.bin"] == (None, 3 << 30, files.TOO_LARGE)
    assert got["gone"][0] is None and "FileNotFoundError" in got["gone"][2]
    assert [os.path.basename(r["path"]) for r in files.read_tree(spark, str(tmp_path)).collect()] == ["small.txt"]


def test_shards_by_payload(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"f{i:02}", "".join(f"token_{i}_{j}_abcdefghijklmno\n" for j in range(64))) for i in range(16)], "doc_id long, path string, text string")
    for target, few in ((1024, False), (1 << 30, True)):
        at = str(tmp_path / str(target))
        write_index(docs, at, "text", target_bytes=target)
        index = open_index(spark, at)
        shards = index.manifest["shards"]
        assert (len(shards) == 1) == few and sum(s["doc_count"] for s in shards) == 16
        base = {s["shard_id"]: (s["doc_base"], s["doc_base"] + s["doc_count"]) for s in shards}
        for r in index.postings.collect():
            low, high = base[r["shard_id"]]
            assert all(low <= d < high for d in r["doc_ids"])
