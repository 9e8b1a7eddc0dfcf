import pytest
from fixtures import DOCS, awkward, empty
from pyspark.sql import functions as F

from grainsift.llm.lines import clean_lines, line_passes

GOOD = ["A plain sentence.", "Is it?", "He said “yes.”", "One thing. And another", "It was 5 p.m. Then it rained:", "日本語の文です。", "Ends (so)."]
BAD = ["Home", "Read more", "no end", "A | B | C | D.", "Home > News > Sport > More.", "We use cookies.", "© 2020 Someone. All rights reserved.", "SHOUTING ALL THE TIME!", "a*** b### c$$$ d.", "• Item", "Log in"]


def test_rules(spark):
    rows = spark.createDataFrame([(x, True) for x in GOOD] + [(x, False) for x in BAD], "line string, good boolean")
    wrong = rows.where(line_passes(F.col("line")) != F.col("good")).collect()
    assert wrong == []


@pytest.mark.parametrize(("text", "kept"), [("A sentence here.\nHome", "A sentence here."), ("Home\nMenu\nOk.", None), ("  Indented line.  \r\n\n\tSecond one.\t", "Indented line.\nSecond one."), ("", None), (" \n ", None), (None, None)])
def test_documents(spark, text, kept):
    got = clean_lines(spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)).collect()
    assert [r["text"] for r in got] == ([] if kept is None else [kept])


def test_share(spark):
    docs = spark.createDataFrame([(1, "Twelve chars.\nwithout end x"), (2, "Twelve chars.\nwithout end xy")], "doc_id long, text string")
    assert [r["doc_id"] for r in clean_lines(docs, 0.5).collect()] == [1]
    assert clean_lines(docs, 0.0).count() == 2


def test_awkward(spark):
    docs = awkward(spark)
    got = clean_lines(docs, report=True)
    assert got.columns == [*docs.columns, "lines", "lines_removed"]
    rows = got.collect()
    ids = [r["doc_id"] for r in rows]
    assert ids.count(0) == 3 and ids.count(None) == 1 and 104 in ids
    assert not {100, 101, 102, 105, 106} & set(ids)
    assert all(r["TOKENS"] == 7 and r["epoch"] == "e" for r in rows)
    assert clean_lines(empty(spark)).count() == 0


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = clean_lines(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
