import pytest
from compare import assert_same

import corpus_pipeline
from grainsift.llm import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert_same(catalogue.queries()[name](spark, sf_dir), duck.sql(SQL[name]))


def test_ten_queries_and_five_stages():
    # operator 8 has a second query, for a given reference
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.queries() if n != "reference_substrings") == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
