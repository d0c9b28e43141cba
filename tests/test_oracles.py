"""Every query of the catalogue against its SQL oracle."""

import pytest
from compare import duck_rows, spark_rows

from pelagos.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    assert spark_rows(catalogue.queries()[name](spark, sf)) == duck_rows(duck, ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
