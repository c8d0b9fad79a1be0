"""Every registered query of the engine against its SQL twin."""

import pytest

from graphfuse.plans import catalogue
from tests.oracle import duck, same


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), duck(sf_dir), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
