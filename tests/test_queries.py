"""Every registered query against its SQL twin over whole tables."""

import pytest

import __spark_entry__ as entry
from compare import assert_same, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


REMOVABLE = {"pipeline", *entry.llm_queries.QUERIES} if entry.llm_queries else set()


def test_every_query_has_a_twin():
    assert set(QUERIES) - REMOVABLE == set(ORACLE) - REMOVABLE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - REMOVABLE))
def test_query(spark, sf_dir, con, name):
    assert assert_same(QUERIES[name](spark, sf_dir), con, ORACLE[name]) > 0
