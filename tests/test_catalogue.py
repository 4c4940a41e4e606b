"""Every registered query against its SQL twin on the small test tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from soundquay.plans import load_catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(load_catalogue()))
def test_query(spark, sf_dir, con, name):
    item = load_catalogue()[name]
    message, rows = compare(spark, con, name, item.build, item.sql, sf_dir)
    assert message is None
    assert rows >= 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
