"""Every query of the core against its SQL twin."""

import pytest

from quireflow.plans import catalog
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"
CATALOG = catalog()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(spark, con, name):
    found = CATALOG.queries[name](spark, SF).toPandas()
    if name in CATALOG.sql:
        assert rows(found) == rows(con.sql(CATALOG.sql[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
