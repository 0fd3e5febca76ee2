"""Every registered query against its SQL on the smallest data; none may be empty."""

import pytest

import __spark_entry__ as entry
from hushmark.plans.catalog import ORACLE, QUERIES
from tests.harness import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"copy_review_all"}  # every detector on rewritten text: see test_rules


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    rows, expected, problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert not problems, problems
    assert rows == expected and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
