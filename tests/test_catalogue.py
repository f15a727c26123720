"""Every query with SQL agrees with it; every other one runs and has a stable schema."""

import pytest
from compare import spark_rows, sql_rows, views

from quernstone.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, sf, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == sql_rows(views(sf), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.schema == catalogue.QUERIES[name](spark, sf).schema
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
