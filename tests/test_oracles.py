"""Every query against DuckDB on the same tables."""

import oracle
import pytest

from __spark_entry__ import entry
from tillwatch.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    names, rows = oracle.spark_rows(QUERIES[name](spark, sf_dir))
    sql = ORACLES[name]
    expected_names, expected = oracle.duck_rows(duck, sql)
    assert names == expected_names
    assert rows == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
