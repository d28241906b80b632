"""Every catalogue query against its SQL, on the smallest tables."""

import pytest

from terrametric.plans import catalogue

from .conftest import DATA
from .oracle import rows_of, sql_rows

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    names, wanted = sql_rows(DATA, ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["display_name", "avg_delay_ratio", "sample_count"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
