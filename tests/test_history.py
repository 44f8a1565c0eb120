"""Stored histories, differences of stored snapshots, and typed tables kept by order."""

from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from promiselens.params import TABLE_PARAMS
from promiselens.plans import facts, staging
from promiselens.sources import sinks
from promiselens.sources.tables import TableFeed
from promiselens.streaming import deltas, history, snapshots

FOLDER = "/root/testdata/sf0.001"
DAY = datetime(2020, 1, 10, 12, 0)
# order, purchase, approval, shipment, delivery, cancellation, unavailable, stuck: hours after DAY
PLANS = [
    (1, 0, 2, 30, 100, None, None, False),
    (2, 0, None, None, None, 24, None, False),
    (3, 5, 5, None, None, None, None, True),
    (4, 5, 6, None, None, None, 53, False),
    (5, 40, 41, 20, 45, None, None, False),  # shipped before it was bought
    (6, 50, 50, 50, 50, 50, None, False),  # all at once
    (7, None, 1, 2, 3, None, None, False),  # never bought
    (8, 60, 61, 62, None, None, None, False),
]


@pytest.fixture(scope="module")
def planned(spark):
    def at(hours):
        return None if hours is None else DAY + timedelta(hours=hours)

    rows = [(p[0], 100 + p[0], *map(at, p[1:7]), p[7], DAY.date()) for p in PLANS]
    schema = (
        "order_id long, customer_id long, purchased_at timestamp_ntz, approved_at timestamp_ntz, shipped_at timestamp_ntz, "
        "delivered_at timestamp_ntz, canceled_at timestamp_ntz, unavailable_at timestamp_ntz, is_stuck boolean, promised_date date"
    )
    return spark.createDataFrame(rows, schema)


def _set(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_history_equals_the_view_of_every_moment(spark, planned, tmp_path):
    stored = history.stored_form(history.order_history(planned))
    sinks.commit(spark, str(tmp_path), {"orders": sinks.write_version(stored, f"{tmp_path}/orders", "until_month")})
    kept = sinks.read_table(spark, str(tmp_path), "orders")
    for hours in (-1, 0, 1, 2, 5, 13, 14, 20, 24, 29, 30, 40, 45, 50, 53, 61, 62, 73, 74, 99, 100, 5000):
        moment = DAY + timedelta(hours=hours)
        assert _set(history.as_of(kept, moment)) == _set(snapshots.orders_as_of(planned, moment)), hours
    never = kept.where("valid_from >= valid_to")
    assert never.isEmpty() and kept.where("order_id = 7").isEmpty()


def test_view_opens_later_months_only(spark, planned, tmp_path):
    old = planned.withColumns({c: F.col(c) - F.expr("interval 3 years") for c in planned.columns if c.endswith("_at")})
    stored = history.stored_form(history.order_history(planned.union(old.select(planned.columns))))
    version = sinks.write_version(stored, f"{tmp_path}/orders", "until_month")
    # The states that ended three years ago are made unreadable: a view of today must not open them.
    ended = [p for p in Path(f"{tmp_path}/orders/{version}").glob("until_month=2017-*/*.parquet")]
    assert ended
    for part in ended:
        part.write_bytes(b"no parquet")
        part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    kept = spark.read.schema(stored.schema).parquet(f"{tmp_path}/orders/{version}")
    assert history.as_of(kept, DAY + timedelta(hours=60)).count() > 0


def test_unequal_buckets_only_are_opened(spark, planned, tmp_path):
    root = str(tmp_path)
    old = planned.withColumns({c: F.col(c) - F.expr("interval 1 year") for c in planned.columns if c.endswith("_at")})
    both = planned.union(old.withColumn("order_id", F.col("order_id") + 1000).select(planned.columns))
    moments = {"before": DAY + timedelta(hours=26), "after": DAY + timedelta(hours=61)}
    views = {name: snapshots.orders_as_of(both, moment) for name, moment in moments.items()}
    for name, view in views.items():
        deltas.store_snapshot(view, f"{root}/{name}", "order_id", F.date_format("purchased_at", "yyyy-MM"), 4)
    unequal = {r["bucket"] for r in deltas.unequal_buckets(sinks.read_table(spark, f"{root}/before", "sums"), sinks.read_table(spark, f"{root}/after", "sums")).collect()}
    assert unequal and all(b.startswith("2020-01") for b in unequal)
    broken = 0
    for part in Path(root).glob("*/rows/*/bucket=*/*.parquet"):
        if part.parent.name.removeprefix("bucket=") not in unequal:
            part.write_bytes(b"no parquet")
            part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
            broken += 1
    assert broken >= 4
    # The schema of the partitioned folders is read from one file, so it is given here.
    kept = {}
    for name in moments:
        _, versions = sinks.latest_generation(spark, f"{root}/{name}")
        schema = deltas.bucketed(views[name], "order_id", F.lit(""), 1).schema
        kept[f"{root}/{name}"] = {
            "rows": spark.read.schema(schema).parquet(f"{root}/{name}/rows/{versions['rows']}"),
            "sums": sinks.read_table(spark, f"{root}/{name}", "sums"),
        }
    real = sinks.read_generation
    sinks.read_generation = lambda spark, root, number=None: kept[root]
    try:
        found = deltas.order_changes(spark, f"{root}/before", f"{root}/after").first().asDict()
        rows = deltas.changed_rows(spark, f"{root}/before", f"{root}/after", "order_id", ["order_status"]).where("not was_there").collect()
    finally:
        sinks.read_generation = real
    before, after = ({r["order_id"]: r["order_status"] for r in v.collect()} for v in (views["before"], views["after"]))
    assert found == {
        "orders_total": len(after),
        "in_transit": sum(s == "shipped" for s in after.values()),
        "delivered_total": sum(s == "delivered" for s in after.values()),
        "new_orders": len(after.keys() - before.keys()),
        "orders_changed_status": sum(before[k] != s for k, s in after.items() if k in before),
        "newly_delivered": sum(s == "delivered" and before[k] != s for k, s in after.items() if k in before),
    }
    assert {r["order_id"] for r in rows} == after.keys() - before.keys()


def test_equal_and_gone_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y")], "order_id long, order_status string, note string")
    for name, df in {"one": rows, "two": rows.repartition(3).orderBy(F.desc("order_id")), "three": rows.where("order_id > 1")}.items():
        deltas.store_snapshot(df, f"{tmp_path}/{name}", "order_id", F.lit("all"), 2)
    assert deltas.changed_rows(spark, f"{tmp_path}/one", f"{tmp_path}/two", "order_id", ["note"]).isEmpty()
    gone = deltas.changed_rows(spark, f"{tmp_path}/one", f"{tmp_path}/three", "order_id", ["note"]).where("not is_there").collect()
    assert [(r["order_id"], r["was_there"]) for r in gone] == [(1, True)]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(order_id" in x]


def test_facts_of_stored_tables_need_no_exchange_by_order(spark, tmp_path):
    feed = TableFeed(spark, FOLDER)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = staging.store(feed, f"{tmp_path}/typed")
        assert _exchanges(facts.order_facts(feed, feed.params))
        assert not _exchanges(facts.order_facts(stored, feed.params))
        # As another session reads them: from the folder alone.
        for version in sinks.latest_generation(spark, f"{tmp_path}/typed")[1].values():
            spark.sql(f"drop table if exists {sinks._bucket_table(version)}")
        again = staging.stored(spark, f"{tmp_path}/typed", feed.params)
        assert not _exchanges(facts.order_facts(again, feed.params))
        assert again.items.count() == feed.items.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_tables_with_a_hot_order_stay_splittable(spark, tmp_path):
    feed = TableFeed(spark, FOLDER, replace(TABLE_PARAMS, hot_key_rows=6, hot_key_sample=2))
    stored = staging.store(feed, f"{tmp_path}/typed")
    versions = sinks.latest_generation(spark, f"{tmp_path}/typed")[1]
    assert "_b" not in versions["items"] and "_b" in versions["orders"]
    assert stored.items.count() == feed.items.count()


def test_buckets_follow_the_rows_of_items_that_look_their_order_up(spark, tmp_path):
    """Catalyst multiplies the sizes of both sides of the join below; a machine's cores are buckets enough for 20,000 rows."""
    feed = TableFeed(spark, FOLDER)
    dated = spark.range(20_000).select(F.col("id").alias("order_id"), F.expr("timestamp_ntz'2020-01-10 12:00:00'").alias("shipping_limit_at"))
    lines = spark.range(20_000).select(F.col("id").alias("order_id"), F.lit(1).alias("order_item_number"))
    feed.items = lines.join(dated, "order_id")
    stored = staging.store(feed, f"{tmp_path}/typed")
    versions = sinks.latest_generation(spark, f"{tmp_path}/typed")[1]
    assert {v.split("_b")[1].split("_")[0] for n, v in versions.items() if n in staging.BY_ORDER} == {str(spark.sparkContext.defaultParallelism)}
    assert stored.items.count() == 20_000


def test_more_rows_get_more_buckets(spark, tmp_path):
    feed = TableFeed(spark, FOLDER, replace(TABLE_PARAMS, bucket_bytes=1024))
    rows = {name: staging.order_rows(getattr(feed, name), spread_by, feed.params)[0] for name, spread_by in staging.BY_ORDER.items()}
    true = feed.items.count()
    assert 0.3 * true < rows["items"] < 3 * true
    assert staging.order_buckets(feed, rows) > spark.sparkContext.defaultParallelism
