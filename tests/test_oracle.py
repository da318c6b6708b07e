"""Every query with SQL gives the SQL's rows; those without give rows at all."""

import pytest

from ticksmith.plans import catalog

from .compare import connect, differences

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0
