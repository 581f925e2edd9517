"""Every query against its SQL, on whole tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as spark_entry
from vecweave.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_own_query_has_sql():
    assert set(QUERIES) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = spark_entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(spark_entry.oracle_sql()[name]).fetchdf()
    assert len(want) > 0
    assert differences(got, want) is None


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
