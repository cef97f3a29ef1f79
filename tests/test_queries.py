"""Every core query runs over its whole tables; those with SQL give the same rows on another engine."""

import pytest
from compare import rows_of, rows_of_sql

from lexspan.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    columns, rows = rows_of(QUERIES[name](spark, data))
    if name in ORACLES:
        assert (columns, rows) == rows_of_sql(duck, ORACLES[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(not n.startswith("p") or n[1:2].isdigit() for n in e.queries())
