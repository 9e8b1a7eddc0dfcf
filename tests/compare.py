"""Equality of a query's rows and its SQL's."""

import pandas as pd


def _value(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(frame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_value(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def assert_same(spark_df, duck_relation) -> None:
    got, want = spark_df.toPandas(), duck_relation.df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
