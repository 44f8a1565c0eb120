"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from promiselens.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry(spark):
    assert entry(spark).count() == 60


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The digest of a file is a stream over its bytes, read by a Python data source; nothing else leaves the JVM.
    for unwanted in ("CartesianProduct", "NestedLoopJoin", *([] if name == "file_manifest" else ["Python"])):
        assert unwanted not in plan
    assert differences(df, duck, oracle_sql()[name]) == []
