"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lexloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted(str(tuple(r)) for r in got.select(columns).toPandas()[columns].itertuples(index=False, name=None))
    assert ours == sorted(str(tuple(r)) for r in want[columns].itertuples(index=False, name=None))


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
