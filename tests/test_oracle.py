"""Every query with SQL gives the same rows as DuckDB, and every other one runs."""

from pathlib import Path

import pytest
from oracle import compare, connect

from tidemark.plans import load

SF = "/root/testdata/sf0.001"
CORE = load()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_same_as_sql(spark, con, name):
    compare(spark, con, CORE.queries[name], CORE.sql[name], SF)


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_runs(spark, name):
    df = CORE.queries[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_has_what_the_driver_asks_for(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
