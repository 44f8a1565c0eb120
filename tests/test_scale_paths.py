"""The paths taken on large tables, forced on small ones, over tables in which keys are hot.

A third of all items belong to one order, a third of all orders to one customer, a third of all items to
one seller and a third of all reviews to one order. Nothing is small enough to broadcast, for the jobs or for
Spark itself, two sampled rows make a key hot, and every result must still equal its SQL.
"""

from dataclasses import replace

import pytest
from compare import TABLES, connect, differences

from __spark_entry__ import oracle_sql
from promiselens.catalog import QUERIES
from promiselens.params import TABLE_PARAMS
from promiselens.session import apply_runtime_settings
from promiselens.sources.tables import TableFeed

SOURCE = "/root/testdata/sf0.001"
LARGE = replace(TABLE_PARAMS, broadcast_limit_bytes=0, hot_key_rows=4, hot_key_sample=2, salts=5)
SKEW = {
    "lineitem": """select * replace (case when l_partkey % 3 = 0 then 1 else l_orderkey end as l_orderkey,
        (row_number() over (order by l_orderkey, l_linenumber, l_extendedprice))::int as l_linenumber,
        case when l_linenumber % 3 = 0 then 7 else l_suppkey end as l_suppkey) from lineitem""",
    "orders": "select * replace (case when o_orderkey % 3 = 0 then 5 else o_custkey end as o_custkey) from orders",
    "events": "select * replace (case when event_id % 3 = 0 then 3 * event_id else event_id end as event_id) from events",
}
NAMES = [
    "order_items_summary", "payment_summary", "latest_review", "order_context", "fct_orders", "fct_order_items",
    "route_performance", "seller_performance", "late_drivers", "promise_backtest", "journey_templates",
    "template_items", "payment_rescale", "profile_deadline_anchor", "dim_sellers", "category_values",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    con = connect(SOURCE)
    for table in TABLES:
        con.execute(f"copy ({SKEW.get(table, f'select * from {table}')}) to '{target}/{table}.parquet' (format parquet)")
    return str(target)


def test_tables_are_skewed(folder):
    con = connect(folder)
    share = con.execute("select max(n) / sum(n) from (select count(*) as n from lineitem group by l_orderkey)").fetchone()[0]
    assert share > 0.3


@pytest.fixture
def never_broadcast(spark):
    """Spark must not broadcast the lookups that the jobs left to a shuffle."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_give_the_same_result(never_broadcast, folder, name):
    feed = TableFeed(apply_runtime_settings(never_broadcast), folder, LARGE)
    assert differences(QUERIES[name](feed), connect(folder), oracle_sql()[name]) == []


def test_salted_join_is_a_shuffle_join(never_broadcast, folder):
    feed = TableFeed(apply_runtime_settings(never_broadcast), folder, LARGE)
    plan = QUERIES["fct_order_items"](feed)._jdf.queryExecution().executedPlan().toString()
    salted = [line for line in plan.splitlines() if "Join" in line and "_salt" in line]
    assert salted and all("SortMergeJoin" in line for line in salted)


def test_hot_key_search_reads_the_raw_tables_only(never_broadcast, folder):
    def scans(params):
        plan = QUERIES["fct_order_items"](TableFeed(apply_runtime_settings(never_broadcast), folder, params))
        return plan._jdf.queryExecution().executedPlan().toString().count("lineitem")

    assert scans(LARGE) <= 2 * scans(TABLE_PARAMS)
