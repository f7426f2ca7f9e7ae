"""Every query of the reference's operators against its SQL, and the driver's contract."""

from __future__ import annotations

import pytest

from platterlens.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, small, duck, same_rows, name):
    same_rows(catalogue.queries()[name](spark, small), duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
