from __future__ import annotations

import pytest
from oracle import rows, tables

from gristmill.plans import all_queries  # noqa: F401
from gristmill.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = tables(sf_dir).execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
