"""Every registered query runs on the smallest tables (the driver's smoke check)."""

import pytest

import __spark_entry__ as E
from conftest import SF001


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF001)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert all(len(r) == len(df.columns) for r in rows)
