"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_matches_sql(spark, name):
    problem = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem
