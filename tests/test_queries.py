"""Every named query against its independent SQL, on the smallest data set."""

import pytest

import __spark_entry__ as driver
import oracle_check

DATA = "/root/testdata/sf0.001"
ORACLE = driver.oracle_sql()
SLOW = {"train_candidates"}


@pytest.fixture(scope="module")
def connection():
    return oracle_check.connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, connection, name):
    df = driver.queries()[name](spark, DATA)
    assert oracle_check.differences(df, connection, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(ORACLE) - SLOW))
def test_query_without_sql_has_rows(spark, name):
    assert driver.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 150


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(driver.queries())
