"""Every registered query gives the rows of its SQL."""

import pytest

from palimpsest import registry
from tests.compare import connection, rows

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    found = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_names_start_with_survey_ids():
    assert all(name[0] in "SPJAWXTNMVRC" and name[1].isdigit() for name in registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
