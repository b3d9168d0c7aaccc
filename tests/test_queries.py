"""Every query against its SQL, and every other query for rows and a stable schema."""

from __future__ import annotations

import pytest

from glyphmill.plans.registry import ORACLES, QUERIES

from .helpers import DATA, duck, same


@pytest.fixture(scope="module")
def c():
    return duck()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, c, name):
    same(QUERIES[name](spark, DATA), c, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert all(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
