"""The queries with SQL against it, over whole tables."""

import pytest

from oracle import compare
from patchwright.llm.entry_points import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, small, name):
    compare(spark, small, queries()[name], oracle_sql()[name])


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
