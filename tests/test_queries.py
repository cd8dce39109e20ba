"""Every query of the engine against its SQL, and the entry point's contract."""

import pytest

import __spark_entry__ as entry
from skarn.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, same, small, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLE:
        same(df, catalog.ORACLE[name], small)
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
