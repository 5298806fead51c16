"""Every query with a DuckDB equivalent gives its rows on the smallest tables."""

import oracle
import pytest

from wayring.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    assert oracle.differences(spark, con, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) == []


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
