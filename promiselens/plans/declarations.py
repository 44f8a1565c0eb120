"""What must hold of every table, as data, and the tables it is checked on."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.functions import rules
from promiselens.operators.declared import Check, holds, in_range, key, not_null, one_of, refers, report, total_of, unique_combination
from promiselens.operators.passes import in_passes, materialise_in_passes, pass_count
from promiselens.params import Params
from promiselens.plans import facts, marts, quality, summaries, timeline

STATUSES, PAYMENTS = tuple(rules.ORDER_STATUSES), tuple(rules.PAYMENT_TYPES)
OUTCOMES = (
    "Late", "On time", "Cancelled", "Delivered, date missing", "Overdue, not delivered", "Open, not yet due",
)
CAUSES = ("Seller shipped late", "After hand-over (carrier or promise)", "Unclear (timestamp issue)")
ITEM_KEY = ("order_id", "order_item_number")

# The declared checks, table by table.
DECLARED: dict[str, list[Check]] = {
    # typed tables
    "orders": key("order_id") + not_null("purchased_at", "promised_date") + one_of("order_status", *STATUSES),
    "items": unique_combination(*ITEM_KEY) + refers("order_id", "orders", "order_id") + refers("seller_id", "sellers", "seller_id")
    + refers("product_id", "products", "product_id") + in_range("price_brl", 0, inclusive=False) + in_range("freight_brl", 0),
    "payments": unique_combination("order_id", "payment_sequence") + one_of("payment_type", *PAYMENTS),
    "reviews": unique_combination("review_id", "order_id") + not_null("review_score") + in_range("review_score", 1, 5),
    "customers": key("customer_id") + refers("customer_state", "states", "state_code"),
    "sellers": key("seller_id") + refers("seller_state", "states", "state_code"),
    "products": key("product_id"),
    "categories": key("category_name_pt"),
    "holidays": not_null("holiday_date"),
    "weather": unique_combination("state_code", "weather_date") + not_null("precipitation_mm") + in_range("precipitation_mm", 0),
    "fx_rates": key("rate_date") + in_range("brl_per_eur", 2, 8),
    "inflation": key("month_start") + not_null("pct_change"),
    # the synthetic feed
    "sim_orders": key("order_id") + one_of("order_status", *STATUSES) + holds(quality.SYNTHETIC_LABELS)
    + holds(quality.EVENTS_IN_ORDER) + holds(quality.NOTHING_AFTER_SNAPSHOT),
    "sim_items": unique_combination(*ITEM_KEY) + refers("order_id", "sim_orders", "order_id")
    + refers("seller_id", "sellers", "seller_id") + refers("product_id", "products", "product_id"),
    "sim_payments": one_of("payment_type", *PAYMENTS),
    "sim_reviews": key("review_id") + in_range("review_score", 1, 5) + holds("review_answered_at <= sim_as_of"),
    "sim_customers": key("customer_id") + refers("customer_state", "states", "state_code"),
    # business rules
    "all_orders": key("order_id") + one_of("data_source", "marketplace", "simulated"),
    "all_customers": key("customer_id"),
    "fx_daily": key("rate_date") + not_null("brl_per_eur"),
    "state_holidays": unique_combination("state_code", "holiday_date"),
    "zip_centroids": key("zip_prefix"),
    "items_summary": key("order_id") + not_null("primary_seller_id"),
    "payments_summary": key("order_id"),
    "reviews_latest": key("order_id"),
    "timeline": key("order_id") + not_null("delivery_outcome") + one_of("delivery_outcome", *OUTCOMES) + one_of("late_cause", *CAUSES),
    "context": key("order_id"),
    # star and result tables
    "fct_orders": key("order_id") + not_null("delivery_outcome", "gmv_eur", "brl_per_eur", "is_synthetic")
    + refers("purchase_date", "dim_date", "date_day") + refers("customer_state", "dim_states", "state_code")
    + refers("primary_seller_id", "dim_sellers", "seller_id") + in_range("days_late", 0) + in_range("gmv_eur", 0)
    + holds("not (is_synthetic and is_in_kpi_window)") + holds("(data_source = 'simulated') = is_synthetic")
    + holds("revenue_at_risk_eur <= gmv_eur and late_gmv_eur <= gmv_eur") + holds("late_cause is not null", "is_late"),
    "fct_order_items": key("order_item_key") + refers("product_id", "dim_products", "product_id") + refers("seller_id", "dim_sellers", "seller_id"),
    "dim_date": key("date_day") + not_null("brl_per_eur"),
    "dim_sellers": key("seller_id"),
    "dim_products": key("product_id") + not_null("category_name_en"),
    "dim_states": key("state_code"),
    "mart_monthly_kpis": key("month_start"),
    "mart_route_performance": key("route"),
    "mart_seller_performance": key("seller_id"),
    "mart_late_drivers": key("driver"),
    "mart_live_daily": key("purchase_date"),
}


def _synthetic(feed) -> dict[str, DataFrame]:
    """The synthetic feed's rows with their labels; a row's label is that of its order."""
    orders = feed.orders.where("is_synthetic")
    ids, labels = orders.select("order_id"), orders.select("order_id", "sim_as_of")
    return {
        "sim_orders": orders,
        "sim_items": summaries.item_keys(feed).join(ids, "order_id", "left_semi"),
        "sim_payments": feed.payments.join(ids, "order_id", "left_semi"),
        "sim_reviews": feed.reviews.join(labels, "order_id"),
        "sim_customers": feed.customers.join(orders.select("customer_id"), "customer_id", "left_semi"),
    }


# Large tables are checked in passes by the first of these that they have.
SPLIT_BY = ("order_id", "order_item_key", "review_id", "customer_id", "seller_id", "product_id")

# What the result tables and the reconciliations read of the facts beside what is declared of them.
ORDER_FACT_NEEDS = {
    *marts.MONTHLY_NEEDS, *marts.ROUTE_NEEDS, *marts.LIVE_NEEDS, *marts.DRIVER_NEEDS, *facts.ITEM_FACT_FROM_ORDER, "gmv_brl",
}
ITEM_FACT_NEEDS = set(marts.SELLER_NEEDS)


def declared_columns(name: str, among: list[str]) -> set[str]:
    """The columns that the declarations of a table name, also within expressions, and those by which other tables refer to it."""
    own = {c for check in DECLARED[name] for c in [*check.columns, *re.findall(r"\w+", f"{check.expression} {check.where}")]}
    referred = {check.parent[1] for checks in DECLARED.values() for check in checks if check.parent and check.parent[0] == name}
    return (own | referred) & set(among)


def checked_tables(feed, params: Params) -> dict[str, DataFrame]:
    """Every table that is declared. What several tables are made of is stored once, with the columns that are read again."""
    typed = {n: getattr(feed, n) for n in DECLARED if hasattr(feed, n)} | {"states": feed.states}
    typed["weather"] = materialise_in_passes(feed.weather, ["state_code"], replace(params, max_passes=1))
    all_columns = facts.ORDER_FACT_COLUMNS
    wanted = declared_columns("fct_orders", all_columns) | ORDER_FACT_NEEDS
    order_facts = facts.order_facts(feed, params, [c for c in all_columns if c in wanted])
    orders = materialise_in_passes(order_facts, ["order_id"], params)
    item_facts = facts.item_facts(feed, params, orders)
    wanted = declared_columns("fct_order_items", item_facts.columns) | ITEM_FACT_NEEDS
    items = materialise_in_passes(item_facts.select(*[c for c in item_facts.columns if c in wanted]), ["order_id"], params)
    deadlines = materialise_in_passes(summaries.items_summary(feed.items), ["order_id"], params)
    holidays = summaries.state_holidays(feed.holidays, feed.states)
    return typed | _synthetic(feed) | {
        "all_orders": feed.orders,
        "all_customers": feed.customers,
        "fx_daily": summaries.fx_daily(feed.fx_rates, params),
        "state_holidays": holidays,
        "zip_centroids": summaries.zip_centroids(feed.geolocation),
        "items_summary": deadlines,
        "payments_summary": summaries.payments_summary(feed.payments),
        "reviews_latest": summaries.latest_reviews(feed.reviews),
        "timeline": timeline.order_timeline(feed.orders, deadlines.select("order_id", "seller_ship_by_at"), params),
        "context": timeline.order_context(feed.orders, feed.customers, holidays, typed["weather"], params),
        "fct_orders": orders,
        "fct_order_items": items,
        "dim_date": facts.date_dimension(feed, params),
        "dim_sellers": facts.seller_dimension(feed, params),
        "dim_products": facts.product_dimension(feed, params),
        "dim_states": feed.states,
        "mart_monthly_kpis": marts.monthly_kpis(orders),
        "mart_route_performance": marts.route_performance(orders, params),
        "mart_seller_performance": marts.seller_performance(items, params),
        "mart_late_drivers": marts.late_drivers(orders, params),
        "mart_live_daily": marts.live_daily(orders),
    }


def reconciliations(orders: DataFrame, items: DataFrame, monthly: DataFrame, source: DataFrame, params: Params) -> DataFrame:
    """(table, check, violations) of what must agree between tables; ``source`` holds prices and freight per feed."""
    model = orders.groupBy("data_source").agg(F.sum("gmv_brl").alias("_model"))
    gap = F.abs(F.col("source_gmv_brl") - F.col("_model"))
    passes = pass_count(quality.items_differ_from_orders(orders, items), params)
    by_order = zip(*[in_passes(df, ["order_id"], passes) for df in (orders, items)])
    lines = {
        ("fct_orders", "value = source"): source.join(model, "data_source", "left").where(F.col("_model").isNull() | (gap > 0.01)),
        ("mart_monthly_kpis", "months of the window"): quality.wrong_month_count(monthly, params),
        ("mart_monthly_kpis", "monthly = orders"): quality.monthly_differs_from_orders(monthly, orders),
    }
    unequal = {("fct_order_items", "items = order"): [quality.items_differ_from_orders(*part) for part in by_order]}
    parts = []
    for (table, check), found in ({at: [df] for at, df in lines.items()} | unequal).items():
        counts = [df.agg(F.count(F.lit(1)).alias("violations")) for df in found]
        counted = total_of(counts, [], "violations", len(counts) > 1)
        parts.append(counted.select(F.lit(table).alias("table"), F.lit(check).alias("check"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def source_values(feed) -> DataFrame:
    """Prices and freight of the items per feed."""
    labelled = feed.items.join(feed.orders.select("order_id", "data_source"), "order_id")
    parts = in_passes(labelled, ["order_id"], pass_count(labelled, feed.params))
    sums = [df.groupBy("data_source").agg(F.sum(F.col("price_brl") + F.col("freight_brl")).alias("source_gmv_brl")) for df in parts]
    total = total_of(sums, ["data_source"], "source_gmv_brl", len(sums) > 1)
    return total.withColumn("source_gmv_brl", F.col("source_gmv_brl").cast("decimal(38,6)"))


def declared_report(tables: dict[str, DataFrame], params: Params, source: DataFrame) -> DataFrame:
    """All declarations and all reconciliations over ``tables``."""
    rows = report(tables, DECLARED, params, SPLIT_BY)
    agree = reconciliations(tables["fct_orders"], tables["fct_order_items"], tables["mart_monthly_kpis"], source, params)
    counts = tables["fct_orders"].agg(F.count(F.lit(1)).alias("_a")).withColumn("_b", tables["all_orders"].agg(F.count(F.lit(1))).scalar())
    same = counts.select(
        F.lit("fct_orders").alias("table"), F.lit("equal_rowcount: all_orders").alias("check"), F.abs(F.col("_a") - F.col("_b")).alias("violations")
    )
    return rows.unionByName(agree).unionByName(same)


def wrong_values(checks: list[Check], kinds: dict[str, str]) -> dict[str, object]:
    """Column -> a value that violates what is declared of it; ``kinds`` are the columns' type names."""
    out: dict[str, object] = {}
    for check in checks:
        name = check.columns[0] if check.columns else ""
        if check.kind == "not_null":
            out[name] = None
        elif check.kind == "accepted_range":
            out[name] = -1
        elif check.kind == "accepted_values":
            out[name] = "no such value"
        elif check.kind == "relationship":
            out[name] = {"string": "no such value", "date": date(1900, 1, 1)}.get(kinds[name], -1)
    return out


def broken(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every declared table with two more copies of its rows: one as it is, and one in which the declared columns are wrong.

    For trying the checks themselves: every kind of check then finds something in every table.
    """
    out = dict(tables)
    for name, checks in DECLARED.items():
        kinds = {f.name: f.dataType for f in tables[name].schema.fields}
        values = wrong_values(checks, {c: k.simpleString() for c, k in kinds.items()})
        bad = tables[name].withColumns({c: F.lit(v).cast(kinds[c]) for c, v in values.items()})
        out[name] = tables[name].unionByName(tables[name]).unionByName(bad)
    return out
