import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from compare import assert_same

from grainsift.catalogue import QUERIES, SQL
from grainsift.functions.ngrams import fnv1a32
from test_ngrams import brute

ROOT = Path(__file__).resolve().parents[1]


WITHOUT_SQL = {"documents_ngram_hashes", "documents_postings", "documents_doc_frequency", "documents_posting_bytes", "documents_index_stats"}


def test_every_other_query_has_sql():
    assert set(QUERIES) == set(SQL) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert_same(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


def test_entry_works_without_llm():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('grainsift.llm'):\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) < set(e.queries())\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "import grainsift.cli, grainsift.engine\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_library_never_imports_llm():
    for p in (ROOT / "grainsift").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "grainsift.llm" not in p.read_text(), p


def test_corpus_index_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = {0: "", 1: "a", 2: "foo foo", 3: None, 4: "é\n" * 40, 5: "needle " * 60, 12_000: "foo bar"}
    texts |= {k: "".join(rng.choice("abc de_1.\n") for _ in range(rng.randint(0, 150))) for k in range(20, 60)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    times = Counter((d, fnv1a32(g)) for d, t in texts.items() if t for g in brute(t.encode()))
    lists = defaultdict(list)
    for d, h in sorted(times):
        lists[h].append(d)

    def got(name):
        return QUERIES[name](spark, str(tmp_path)).collect()

    assert {(r["doc_id"], r["hash"]): r["times"] for r in got("documents_ngram_hashes")} == dict(times)
    sharded = {(r["hash"], r["shard_id"]): r["doc_ids"] for r in got("documents_postings")}
    assert sharded == {(h, s): part for h, ds in lists.items() for s in (0, 1) if (part := [d for d in ds if d // 10_000 == s])}
    assert {r["hash"]: r["df"] for r in got("documents_doc_frequency")} == {h: len(ds) for h, ds in lists.items()}

    def varint(n):
        return max(1, -(-n.bit_length() // 7))

    sizes = {h: 0 if len(ds) == 1 else varint(len(ds)) + sum(varint(b - a) for a, b in zip([0, *ds[:-1]], ds, strict=True)) for h, ds in lists.items()}
    assert {r["hash"]: r["bytes"] for r in got("documents_posting_bytes")} == sizes
    (stats,) = got("documents_index_stats")
    assert stats.asDict() == {"pairs": sum(times.values()), "unique_pairs": len(times), "lookup_rows": len(lists), "inline_singletons": sum(len(x) == 1 for x in lists.values()), "payload_bytes": sum(sizes.values())}
