"""Landed files -> typed tables -> facts, and the sinks."""

import hashlib
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from promiselens.params import Params
from promiselens.plans import facts, marts, staging
from promiselens.sources import fixed_values, registry, sinks

FILES = {
    "shop/x_orders_dataset.csv": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,2018-01-03 09:00:00,2018-01-13 12:00:00,2018-01-10 00:00:00
"o2",c2,shipped,2018-01-02 10:00:00,"",,,2018-01-20 00:00:00
""",
    "shop/x_order_items_dataset.csv": """"order_id","order_item_id","product_id","seller_id","shipping_limit_date","price","freight_value"
o1,1,p1,s1,2018-01-05 23:59:59,100.00,10.50
o2,1,p2,s1,2018-01-06 23:59:59,20.00,5.00
""",
    "shop/x_order_payments_dataset.csv": """order_id,payment_sequential,payment_type,payment_installments,payment_value
o1,1,boleto,1,110.50
o2,1,credit_card,3,25.00
""",
    "shop/x_order_reviews_dataset.csv": 'review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n'
    'r1,o1,1,,"two lines,\nand a ""quote""",2018-01-14 00:00:00,2018-01-15 08:00:00\nr2,o2,5,,"  ",2018-01-21 00:00:00,2018-01-22 08:00:00\n',
    "shop/x_customers_dataset.csv": """customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state
c1,u1,01001,sao paulo,sp
c2,u2,20040,rio de janeiro,RJ
""",
    "shop/x_sellers_dataset.csv": """seller_id,seller_zip_code_prefix,seller_city,seller_state
s1,01001,sao paulo,SP
""",
    "shop/x_products_dataset.csv": """product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm
p1,pc_gamer,40,200,2,600,10,10,10
p2,,,,,,,,
""",
    "shop/x_geolocation_dataset.csv": """geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state
01001,-23.55,-46.63,sao paulo,SP
01001,-23.57,-46.65,sao paulo,SP
20040,-22.90,-43.17,rio de janeiro,RJ
20040,45.00,9.00,elsewhere,RJ
""",
    "shop/product_category_name_translation.csv": "﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n",
    "sim/sim_orders.csv": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date,data_source,is_synthetic,sim_as_of
sim-1,sc1,shipped,2026-09-20 10:00:00,2026-09-20 10:05:00,2026-09-21 10:00:00,,2026-10-01 00:00:00,simulated,true,2026-10-10 02:00:00
""",
    "sim/sim_order_items.csv": """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value,data_source,is_synthetic,sim_as_of
sim-1,1,p1,s1,2026-09-25 10:00:00,155.00,15.00,simulated,true,2026-10-10 02:00:00
""",
    "sim/sim_order_payments.csv": """order_id,payment_sequential,payment_type,payment_installments,payment_value,data_source,is_synthetic,sim_as_of
sim-1,1,boleto,1,170.00,simulated,true,2026-10-10 02:00:00
""",
    "sim/sim_order_reviews.csv": """review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp,data_source,is_synthetic,sim_as_of
""",
    "sim/sim_customers.csv": """customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state,data_source,is_synthetic,sim_as_of
sc1,su1,20040,rio de janeiro,RJ,simulated,true,2026-10-10 02:00:00
""",
}
LINEAGE = {"_source_url": "u", "_ingested_at": "t"}
NDJSON = {
    "holidays/holidays_BR_2018.ndjson": [
        {"date": "2018-01-01", "localName": "Ano", "name": "New Year", "countryCode": "BR", "fixed": False, "global": True,
         "counties": None, "launchYear": None, "types": ["Public"], **LINEAGE},
        {"date": "2018-01-08", "localName": "Dia", "name": "State Day", "countryCode": "BR", "fixed": False, "global": False,
         "counties": ["BR-SP"], "launchYear": None, "types": ["Bank", "School"], **LINEAGE},
    ],
    "weather/weather_SP.ndjson": [
        {"state_code": "SP", "grid_latitude": -23.5, "grid_longitude": -46.6, "timezone": "x", "time": "2018-01-04",
         "precipitation_sum": 25.5, "temperature_2m_max": 30.0, "temperature_2m_min": 20.0, **LINEAGE}],
    "fx/fx_EUR_BRL.ndjson": [
        {"date": "2017-12-29", "base": "EUR", "quote": "BRL", "rate": 4.0, **LINEAGE},
        {"date": "2017-12-29", "base": "EUR", "quote": "USD", "rate": 1.2, **LINEAGE}],
    "ipca/ipca_BR.ndjson": [{"month": "2018-01", "pct_change": 0.29, **LINEAGE}],
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    for name, text in FILES.items():
        path = folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8", newline="")
    for name, records in NDJSON.items():
        path = folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps(r) + "\n" for r in records), encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def feed(spark, root):
    from datetime import date

    return staging.LandedFeed(spark, root, Params(calendar_end=date(2026, 12, 31)))


def test_records_not_lines_are_counted(spark, root):
    reviews = registry.load_raw(spark, root, "order_reviews")
    assert reviews.count() == 2
    assert registry.reconcile_rows(reviews, reviews.cache(), "order_reviews") == 2
    with pytest.raises(ValueError, match="2 records"):
        registry.reconcile_rows(reviews, reviews.limit(1), "order_reviews")
    assert [r.has_comment for r in staging.reviews(reviews, Params()).orderBy("review_id").collect()] == [True, False]


def test_header_with_byte_order_mark(feed):
    assert {r.category_name_pt for r in feed.categories.collect()} == {
        "beleza_saude", "pc_gamer", "portateis_cozinha_e_preparadores_de_alimentos",
    }


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="orders"):
        registry.load_raw(spark, str(tmp_path), "orders").count()


def test_every_table_reads(spark, root):
    tables = {name: registry.load_raw(spark, root, name) for name in registry.RAW_TABLES}
    counts = {r.table: r.rows for r in registry.row_counts(tables).collect()}
    assert counts["orders"] == 2 and counts["sim_orders (SYNTHETIC)"] == 1 and counts["sim_order_reviews (SYNTHETIC)"] == 0
    types = registry.column_types(tables)
    assert ("orders", "order_id", "string") in types and ("holidays", "counties", "array<string>") in types


def test_typed_tables(feed):
    orders = {r.order_id: r for r in feed.orders.collect()}
    assert orders["o2"].approved_at is None and str(orders["o1"].promised_date) == "2018-01-10"
    assert orders["o1"].data_source == "marketplace" and orders["sim-1"].is_synthetic
    customer = feed.customers.where("customer_id = 'c1'").first()
    assert (customer.customer_zip_prefix, customer.customer_state) == ("01001", "SP")
    assert [r.category_name_pt for r in feed.products.orderBy("product_id").collect()] == ["pc_gamer", None]
    assert feed.fx_rates.count() == 1
    flags = [(r.is_nationwide, r.is_public_holiday, r.is_bank_holiday) for r in feed.holidays.orderBy("holiday_date").collect()]
    assert flags == [(True, True, False), (False, False, True)]
    assert str(feed.inflation.first().month_start) == "2018-01-01"


def test_facts_from_landed_files(feed):
    found = {r.order_id: r for r in facts.order_facts(feed, feed.params).collect()}
    o1, o2, sim = found["o1"], found["o2"], found["sim-1"]
    assert (o1.delivery_outcome, o1.days_late, o1.route, o1.customer_region) == ("Late", 3, "SP -> SP", "Southeast")
    assert o1.late_cause == "After hand-over (carrier or promise)"
    assert o1.gmv_eur == pytest.approx(110.5 / 4) and o1.revenue_at_risk_eur == o1.late_gmv_eur == o1.gmv_eur
    assert (o1.weekday_holidays_first_10_days, o1.heavy_rain_days_first_7_days_transit) == (2, 1)
    assert o1.distance_km == pytest.approx(0) and o1.distance_band == "1: under 250 km"
    assert (o2.delivery_outcome, o2.revenue_at_risk_reason) == ("Overdue, not delivered", "Overdue, never delivered")
    assert 300 < o2.distance_km < 400
    assert sim.delivery_outcome == "Overdue, not delivered" and not sim.is_in_kpi_window
    items = facts.item_facts(feed, feed.params)
    assert items.count() == 3
    sellers = marts.seller_performance(items, feed.params).collect()
    assert [(s.seller_id, s.orders, s.late_rate, s.is_rankable) for s in sellers] == [("s1", 2, 1.0, False)]
    products = {r.product_id: r for r in facts.product_dimension(feed, feed.params).collect()}
    assert products["p1"].category_name_en == "pc_gamer" and products["p2"].category_name_en == "unknown"


def test_asked_columns_decide_the_joins(feed):
    plan = facts.order_facts(feed, feed.params, ["order_id", "is_late"])._jdf.queryExecution().optimizedPlan().toString()
    assert "payment_value" not in plan and "review_score" not in plan and "geolocation" not in plan


def test_manifest_and_expected_files(spark, root):
    table = registry.RAW_TABLES["order_reviews"]
    row = registry.manifest(spark, root, table).first()
    content = FILES["shop/x_order_reviews_dataset.csv"].encode()
    assert (row.file, row.bytes, row.rows) == ("x_order_reviews_dataset.csv", len(content), 2)
    assert row.sha256 == hashlib.sha256(content).hexdigest()
    missing = registry.missing_files(spark, f"{root}/shop/*.csv", ["x_sellers_dataset.csv", "x_gone.csv"])
    assert [r.file for r in missing.collect()] == ["x_gone.csv"]


def test_states(spark):
    states = fixed_values.states(spark)
    assert states.count() == 27 and states.select("state_code").distinct().count() == 27
    inside = F.col("capital_latitude").between(-34, 6) & F.col("capital_longitude").between(-74, -34)
    assert states.where(~inside).isEmpty()


def test_csv_and_json_round_trip(spark, tmp_path, feed):
    orders = feed.orders.where("not is_synthetic").select(
        *[F.col(a).alias(b) for a, b in zip(feed.orders.columns[:7], registry.ORDERS.split())],
        F.col("promised_date").cast("timestamp_ntz").alias("order_estimated_delivery_date"),
        "data_source", "is_synthetic", "sim_as_of",
    )
    sinks.write_csv_text(orders, f"{tmp_path}/sim/sim_orders.csv")
    back = staging.orders(registry.load_raw(spark, str(tmp_path), "sim_orders"), Params())
    assert sorted(map(str, back.collect())) == sorted(map(str, feed.orders.where("not is_synthetic").collect()))
    stamped = sinks.with_lineage(feed.inflation.select(F.lit("2018-01").alias("month"), "pct_change"), "here", "now")
    sinks.write_ndjson(stamped, f"{tmp_path}/ipca/ipca_BR.ndjson")
    row = registry.load_raw(spark, str(tmp_path), "inflation_monthly").first()
    assert (row.month, row.pct_change, row._source_url, row._ingested_at) == ("2018-01", 0.29, "here", "now")


def test_export_turns_decimals_into_doubles(spark, tmp_path, feed):
    items = feed.items.withColumn("month", F.trunc("shipping_limit_at", "month"))
    sinks.export_parquet({"items": items}, str(tmp_path), {"items": "month"})
    back = sinks.read_table(spark, str(tmp_path), "items")
    assert dict(back.dtypes)["price_brl"] == "double" and back.count() == 3


def test_failed_refresh_keeps_the_old_table(spark):
    sinks.replace_table(spark.range(3), "refreshed")
    sinks.replace_table(spark.range(5), "refreshed")
    assert spark.table("refreshed").count() == 5
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(2).select(F.raise_error(F.lit("broken")).alias("id")), "refreshed")
    assert spark.table("refreshed").count() == 5


def test_cache_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(4)

    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/cache", build).count() == 4
    assert built == [1]


def test_cache_never_reads_what_a_failed_job_left(spark, tmp_path):
    spark.range(9).write.parquet(f"{tmp_path}/cache/v-unfinished")
    with pytest.raises(Exception):
        sinks.cached(spark, f"{tmp_path}/cache", lambda: spark.range(2).select(F.raise_error(F.lit("broken")).alias("id")))
    assert sinks.cached(spark, f"{tmp_path}/cache", lambda: spark.range(4)).count() == 4


def _breaking(feed, name):
    """The feed with one table that fails while it is written."""
    table = getattr(feed, name)
    first = table.columns[0]
    kind = table.schema[first].dataType
    broken = table.withColumn(first, F.when(F.rand(1) >= 0, F.raise_error(F.lit("broken")).cast(kind)))
    names = {n: getattr(feed, n) for n in staging.MODEL_TABLES}
    return SimpleNamespace(spark=feed.spark, params=feed.params, **(names | {name: broken}))


def test_failing_refresh_leaves_typed_and_star_tables(spark, tmp_path, feed):
    from promiselens.plans import star

    typed = staging.store(feed, f"{tmp_path}/typed")
    star.build(typed, feed.params, f"{tmp_path}/star")
    with pytest.raises(Exception):
        staging.store(_breaking(feed, "weather"), f"{tmp_path}/typed")
    assert staging.stored(spark, f"{tmp_path}/typed", feed.params).orders.count() == typed.orders.count()
    with pytest.raises(Exception):
        star.build(_breaking(typed, "products"), feed.params, f"{tmp_path}/star")
    kept = star.current(spark, f"{tmp_path}/star")
    assert kept["fct_orders"].count() == 3 and kept["dim_products"].count() == typed.products.count()


def test_reports_on_landed_files(feed):
    from promiselens.plans import quality

    found = {r.check: r.violations for r in quality.synthetic_report(feed, feed.params).collect()}
    assert len(found) == 15 and set(found.values()) == {0}
    model = {r.check: r.violations for r in quality.model_report(feed, feed.params).collect()}
    assert model["orders.order_id unique"] == 0 and model["items.seller_id in sellers"] == 0
    fact = {r.check: r.violations for r in quality.fact_report(feed, feed.params).collect()}
    assert set(fact.values()) == {0}


def test_second_path_from_text(spark, tmp_path, root, feed):
    import shutil

    from promiselens.plans import facts, verify

    seen = verify.from_facts(facts.order_facts(feed, feed.params, verify.FACT_NEEDS))
    same = verify.compare_metrics(verify.recomputed_from_text(spark, root, feed.params), seen).collect()
    assert len(same) == 10 and all(r.match or r.expected is r.actual is None for r in same)
    # A price that changes in the files only is noticed in every sum of money it is part of.
    other = shutil.copytree(root, tmp_path / "other")
    items = next(other.glob("*/*_order_items_dataset.csv"))
    lines = items.read_text(encoding="utf-8").splitlines()
    cells = lines[1].split(",")
    cells[-2] = '"' + str(float(cells[-2].strip('"')) + 5) + '"'
    items.write_text("\n".join([lines[0], ",".join(cells), *lines[2:]]) + "\n", encoding="utf-8")
    found = verify.compare_metrics(verify.recomputed_from_text(spark, str(other), feed.params), seen).collect()
    wrong = {r.metric for r in found if not r.match}
    assert {"GMV (BRL)", "GMV (EUR)"} <= wrong and "Orders in KPI window" not in wrong


def test_full_refresh(spark, tmp_path, feed):
    from promiselens.plans import star

    typed = staging.store(feed, f"{tmp_path}/typed")
    tables = star.build(typed, feed.params, f"{tmp_path}/star")
    assert tables["fct_orders"].count() == 3 and tables["mart_monthly_kpis"].count() == 1
    assert len(tables) == 11
    star.export(tables, f"{tmp_path}/export")
    exported = sinks.read_table(spark, f"{tmp_path}/export", "fct_orders")
    assert dict(exported.dtypes)["gmv_brl"] == "double" and exported.count() == 3
    plan = tables["fct_orders"].where("purchase_month = '2018-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan


def test_star_scans_skip_months(spark, tmp_path, feed):
    from datetime import date

    from promiselens.plans import findings, star

    typed = staging.store(feed, f"{tmp_path}/typed")
    params = feed.params
    orders = star.build(typed, params, f"{tmp_path}/star")["fct_orders"]
    window = star.months(orders, params.kpi_start, params.kpi_end)
    tests = star.months(orders, params.train_start, params.test_end)
    for df in (marts.monthly_kpis(window), findings.promise_backtest(tests, params)):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "purchase_month" in x]
        assert scans and all("PartitionFilters: [isnotnull(purchase_month" in x for x in scans)
    assert star.months(orders, date(2018, 1, 1), date(2018, 1, 31)).count() == orders.where("purchase_date < '2018-02-01'").count()


@pytest.fixture(scope="module")
def small(spark):
    return {name: spark.range(n).withColumnRenamed("id", name) for n, name in enumerate(("a", "b", "c", "d"), start=1)}


def _commit_all(spark, root, tables, stop_after=None):
    """Write table after table as a refresh does; stop before the commit, or after ``stop_after`` tables."""
    versions = {}
    for n, (name, df) in enumerate(tables.items()):
        if n == stop_after:
            raise RuntimeError("stopped")
        versions[name] = sinks.write_version(df, f"{root}/{name}")
    if stop_after == len(tables):
        raise RuntimeError("stopped")
    return sinks.commit(spark, root, versions)


def _sizes(spark, root, number=None):
    return {name: df.count() for name, df in sinks.read_generation(spark, root, number).items()}


def test_stop_between_any_two_tables_reads_one_whole_generation(spark, tmp_path, small):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        sinks.read_generation(spark, root)
    assert _commit_all(spark, root, small) == 1
    first = {"a": 1, "b": 2, "c": 3, "d": 4}
    doubled = {name: df.union(df) for name, df in small.items()}
    for stop in range(len(small) + 1):
        with pytest.raises(RuntimeError):
            _commit_all(spark, root, doubled, stop)
        assert _sizes(spark, root) == first
    held = sinks.read_generation(spark, root)
    assert _commit_all(spark, root, doubled) == 2
    assert _sizes(spark, root) == {name: 2 * n for name, n in first.items()} and _sizes(spark, root, 1) == first
    assert {name: df.count() for name, df in held.items()} == first  # a reader keeps the generation it began with


def test_commits_in_conflict(spark, tmp_path, small):
    root = str(tmp_path)
    _commit_all(spark, root, small)
    version = sinks.write_version(spark.range(9), f"{root}/a")
    assert sinks.commit(spark, root, {"a": version}, based_on=1) == 2
    assert _sizes(spark, root) == {"a": 9, "b": 2, "c": 3, "d": 4}  # the others keep their versions
    with pytest.raises(sinks.CommitConflict):
        sinks.commit(spark, root, {"a": version}, based_on=1)
    # Two commits of one number: every reader sees the row of the smaller id.
    rows = [(3, "b" * 32, {"a": version}), (3, "a" * 32, {"b": "v-x", "a": version})]
    spark.createDataFrame(rows, "number long, id string, tables map<string,string>").write.mode("append").parquet(f"{root}/generations")
    assert sinks.latest_generation(spark, root) == (3, {"b": "v-x", "a": version})


def test_old_versions_expire(spark, tmp_path, small):
    root = str(tmp_path)
    _commit_all(spark, root, small)
    loose = sinks.write_version(spark.range(1), f"{root}/a")  # of a run under way
    for n in range(3):
        sinks.commit(spark, root, {"a": sinks.write_version(spark.range(n), f"{root}/a")})
    dropped = sinks.expire(spark, root, keep=2)
    assert len(dropped) == 2 and all(f.startswith("a/") for f in dropped)
    assert _sizes(spark, root) == {"a": 2, "b": 2, "c": 3, "d": 4} and _sizes(spark, root, 3)["a"] == 1
    assert sinks.read_version(spark, f"{root}/a", loose).count() == 1
    assert sinks.expire(spark, root, keep=2) == []
