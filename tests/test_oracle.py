"""Each query against its SQL at the smallest scale."""

import oracle
import pytest
from vecspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_give_valid_edges(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows
    assert len({(r.src, r.dst) for r in rows}) == len(rows)
    assert all(r["rank"] <= catalog.K and r.sim > 0 for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
