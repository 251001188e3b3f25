"""Every query of the engine against its SQL, or, without SQL, that it runs."""

import pytest
from oracle import compare, connect

from orrery import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf, name):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql:
        compare(con, sql, df)
    else:
        df.collect()
