"""Every query that has SQL is held against it; the others are run."""

import pytest
from oracle import compare

from patchwright.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, name):
    compare(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_imports_and_has_all(spark, small):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
