import pytest
from oracle import compare, connected

from transcripta.plans import catalog


@pytest.fixture(scope="module")
def db():
    return connected()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, db, name):
    compare(spark, db, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
