"""Every query of the engine against its SQL."""

import math

import pandas as pd
import pytest

from lodegraph.plans import registry


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6)).removesuffix(".0")
    return "null" if v is None or v is pd.NA or v is pd.NaT else str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
