"""The declared checks of the model and the reconciliations between its layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.functions import rules
from promiselens.operators import checks
from promiselens.operators.joins import lookup_join
from promiselens.params import Params
from promiselens.plans import facts, marts, summaries


def _violations(name: str, violating: DataFrame) -> DataFrame:
    return violating.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def _nulls(table: str, *columns: str) -> dict:
    return {f"{table}.{c} not null": F.col(c).isNull() for c in columns}


SYNTHETIC_LABELS = "is_synthetic and data_source = 'simulated'"
# Synthetic ids carry a prefix where ids are text.
SYNTHETIC_IDS = "order_id like 'sim-%'"
EVENTS_IN_ORDER = (
    "(approved_at is null or approved_at >= purchased_at) and (shipped_at is null or shipped_at >= approved_at) "
    "and (delivered_at is null or delivered_at >= shipped_at)"
)
NOTHING_AFTER_SNAPSHOT = (
    "purchased_at <= sim_as_of and (approved_at is null or approved_at <= sim_as_of) "
    "and (shipped_at is null or shipped_at <= sim_as_of) and (delivered_at is null or delivered_at <= sim_as_of)"
)


def model_report(feed, params: Params) -> DataFrame:
    """(check, violations) over the model tables: row checks share one scan per table."""
    synthetic = feed.orders.where("is_synthetic")
    row_checks = [
        checks.count_violations(
            feed.orders,
            {
                **_nulls("orders", "order_id", "purchased_at", "promised_date"),
                "orders.order_status accepted": ~F.col("order_status").isin(rules.ORDER_STATUSES),
            },
        ),
        checks.count_violations(
            synthetic,
            {
                "synthetic orders are labelled": ~F.expr(SYNTHETIC_LABELS),
                "synthetic events in order": ~F.expr(EVENTS_IN_ORDER),
                "synthetic nothing after snapshot": ~F.expr(NOTHING_AFTER_SNAPSHOT),
            },
        ),
        checks.count_violations(
            feed.items,
            {
                "items.price_brl above 0": checks.out_of_range("price_brl", low=0, inclusive=False),
                "items.freight_brl at least 0": checks.out_of_range("freight_brl", low=0),
            },
        ),
        checks.count_violations(
            feed.payments, {"payments.payment_type accepted": ~F.col("payment_type").isin(rules.PAYMENT_TYPES)}
        ),
        checks.count_violations(
            feed.reviews,
            {
                **_nulls("reviews", "review_score"),
                "reviews.review_score 1 to 5": checks.out_of_range("review_score", 1, 5),
            },
        ),
        checks.count_violations(feed.customers, _nulls("customers", "customer_id")),
        checks.count_violations(feed.sellers, _nulls("sellers", "seller_id")),
        checks.count_violations(feed.products, _nulls("products", "product_id")),
        checks.count_violations(
            feed.fx_rates,
            {**_nulls("fx", "rate_date"), "fx.brl_per_eur 2 to 8": checks.out_of_range("brl_per_eur", 2, 8)},
        ),
        checks.count_violations(
            feed.weather,
            {
                **_nulls("weather", "precipitation_mm"),
                "weather.precipitation_mm at least 0": checks.out_of_range("precipitation_mm", 0),
            },
        ),
        checks.count_violations(feed.inflation, _nulls("inflation", "month_start", "pct_change")),
        checks.count_violations(feed.holidays, _nulls("holidays", "holiday_date")),
    ]
    keyed = {
        "orders.order_id unique": checks.unique(feed.orders, "order_id"),
        "items (order, number) unique": checks.unique_combination(summaries.item_keys(feed), "order_id", "order_item_number"),
        "payments (order, sequence) unique": checks.unique_combination(feed.payments, "order_id", "payment_sequence"),
        "reviews (review, order) unique": checks.unique_combination(feed.reviews, "review_id", "order_id"),
        "customers.customer_id unique": checks.unique(feed.customers, "customer_id"),
        "sellers.seller_id unique": checks.unique(feed.sellers, "seller_id"),
        "products.product_id unique": checks.unique(feed.products, "product_id"),
        "categories.category_name_pt unique": checks.unique(feed.categories, "category_name_pt"),
        "fx.rate_date unique": checks.unique(feed.fx_rates, "rate_date"),
        "inflation.month_start unique": checks.unique(feed.inflation, "month_start"),
        "weather (state, day) unique": checks.unique_combination(feed.weather, "state_code", "weather_date"),
        "items.order_id in orders": checks.relationship(summaries.item_keys(feed), "order_id", feed.orders, "order_id"),
        "items.seller_id in sellers": checks.relationship(summaries.item_keys(feed), "seller_id", feed.sellers, "seller_id"),
        "items.product_id in products": checks.relationship(summaries.item_keys(feed), "product_id", feed.products, "product_id"),
        "customers.state in states": checks.relationship(
            feed.customers, "customer_state", feed.states, "state_code"
        ),
        "sellers.state in states": checks.relationship(feed.sellers, "seller_state", feed.states, "state_code"),
    }
    parts = row_checks + [_violations(name, df) for name, df in keyed.items()]
    return reduce(DataFrame.unionByName, parts)


def synthetic_report(feed, params: Params) -> DataFrame:
    """(check, violations) over the landed synthetic tables, which carry their own labels."""
    from promiselens.plans import staging

    orders = staging.orders(feed.raw("sim_orders"), params)
    reviews = staging.reviews(feed.raw("sim_order_reviews"), params)
    items = staging.items(feed.raw("sim_order_items"), params)
    customers = staging.customers(feed.raw("sim_customers"), params)
    row_checks = [
        checks.count_violations(
            orders,
            {
                "synthetic orders are labelled": ~F.expr(f"{SYNTHETIC_IDS} and {SYNTHETIC_LABELS}"),
                "synthetic events in order": ~F.expr(EVENTS_IN_ORDER),
                "synthetic nothing after snapshot": ~F.expr(NOTHING_AFTER_SNAPSHOT),
                "synthetic order_status accepted": ~F.col("order_status").isin(rules.ORDER_STATUSES),
            },
        ),
        checks.count_violations(
            reviews,
            {
                **_nulls("synthetic reviews", "review_id"),
                "synthetic reviews answered by the snapshot": ~F.expr("review_answered_at <= sim_as_of"),
                "synthetic review_score 1 to 5": checks.out_of_range("review_score", 1, 5),
            },
        ),
    ]
    keyed = {
        "synthetic orders.order_id unique": checks.unique(orders, "order_id"),
        "synthetic reviews.review_id unique": checks.unique(reviews, "review_id"),
        "synthetic customers.customer_id unique": checks.unique(customers, "customer_id"),
        "synthetic items (order, number) unique": checks.unique_combination(items, "order_id", "order_item_number"),
        "synthetic items.order_id in orders": checks.relationship(items, "order_id", orders, "order_id"),
        "synthetic items.seller_id in sellers": checks.relationship(items, "seller_id", feed.sellers, "seller_id"),
        "synthetic items.product_id in products": checks.relationship(
            items, "product_id", feed.products, "product_id"
        ),
        "synthetic customers.state in states": checks.relationship(
            customers, "customer_state", feed.states, "state_code"
        ),
    }
    parts = row_checks + [_violations(name, df) for name, df in keyed.items()]
    return reduce(DataFrame.unionByName, parts)


FACT_NEEDS = [
    "order_id", "is_synthetic", "data_source", "is_in_kpi_window", "gmv_eur", "late_gmv_eur", "revenue_at_risk_eur",
    "is_late", "late_cause", "delivery_outcome", "days_late", "brl_per_eur",
]


def fact_report(feed, params: Params, orders: DataFrame | None = None) -> DataFrame:
    """(check, violations) over the order fact, in one pass."""
    if orders is None:
        orders = facts.order_facts(feed, params, FACT_NEEDS)
    noise = 1e-9  # of double arithmetic
    return checks.count_violations(
        orders,
        {
            **_nulls("fact", "order_id", "is_synthetic", "delivery_outcome", "gmv_eur", "brl_per_eur"),
            "no synthetic order in the KPI window": F.col("is_synthetic") & F.col("is_in_kpi_window"),
            "label agrees with is_synthetic": (F.col("data_source") == params.synthetic_source)
            != F.col("is_synthetic"),
            "risk and late value within order value": (F.col("revenue_at_risk_eur") > F.col("gmv_eur") + noise)
            | (F.col("late_gmv_eur") > F.col("gmv_eur") + noise),
            "late orders have a cause": F.col("is_late") & F.col("late_cause").isNull(),
            "days_late at least 0": checks.out_of_range("days_late", 0),
            "gmv_eur at least 0": checks.out_of_range("gmv_eur", 0),
        },
    )


def mart_report(feed, params: Params, orders: DataFrame, items: DataFrame) -> DataFrame:
    """(check, violations) over the keys of dimensions and result tables; pass written facts."""
    days = facts.date_dimension(feed, params)
    keyed = {
        "fct_order_items.order_item_key unique": checks.unique(items, "order_item_key"),
        "fct_orders.purchase_date in dim_date": checks.relationship(orders, "purchase_date", days, "date_day"),
        "fct_orders.customer_state in dim_states": checks.relationship(
            orders, "customer_state", feed.states, "state_code"
        ),
        "dim_date.date_day unique": checks.unique(days, "date_day"),
        "dim_sellers.seller_id unique": checks.unique(facts.seller_dimension(feed, params), "seller_id"),
        "dim_products.product_id unique": checks.unique(facts.product_dimension(feed, params), "product_id"),
        "monthly.month_start unique": checks.unique(marts.monthly_kpis(orders), "month_start"),
        "routes.route unique": checks.unique(marts.route_performance(orders, params), "route"),
        "drivers.driver unique": checks.unique(marts.late_drivers(orders, params), "driver"),
        "live.purchase_date unique": checks.unique(marts.live_daily(orders), "purchase_date"),
    }
    parts = [_violations(name, df) for name, df in keyed.items()]
    return reduce(DataFrame.unionByName, parts)


def value_differs_from_source(feed, params: Params, tolerance: float = 0.01) -> DataFrame:
    """Feeds whose value in the fact is missing or differs from prices + freight in their items."""
    labels = feed.orders.select("order_id", "data_source")
    spread = ["order_item_number", "product_id"]
    labelled = lookup_join(feed.items, labels, ["order_id"], params, "inner", summaries.item_keys(feed), spread)
    source = labelled.groupBy("data_source").agg(
        F.sum(F.col("price_brl") + F.col("freight_brl")).cast("decimal(38,6)").alias("source_gmv_brl")
    )
    model = facts.order_facts(feed, params, ["data_source", "gmv_brl"]).groupBy("data_source").agg(
        F.sum("gmv_brl").alias("model_gmv_brl")
    )
    gap = F.abs(F.col("source_gmv_brl") - F.col("model_gmv_brl"))
    return source.join(model, "data_source", "left").where(F.col("model_gmv_brl").isNull() | (gap > tolerance))


def wrong_month_count(monthly: DataFrame, params: Params) -> DataFrame:
    """One row when the KPI window does not hold exactly its months."""
    start, end = params.kpi_start, params.kpi_end
    expected = (end.year - start.year) * 12 + end.month - start.month + 1
    return monthly.agg(F.count(F.lit(1)).alias("months")).where(F.col("months") != expected)


def monthly_differs_from_orders(monthly: DataFrame, orders: DataFrame, tolerance: float = 0.01) -> DataFrame:
    total = orders.where("is_in_kpi_window").agg(F.sum("revenue_at_risk_eur")).scalar()
    totals = monthly.agg(F.sum("revenue_at_risk_eur").alias("monthly_total")).withColumn("orders_total", total)
    return totals.where(F.abs(F.col("monthly_total") - F.col("orders_total")) > tolerance)


def items_differ_from_orders(orders: DataFrame, items: DataFrame, tolerance: float = 0.001) -> DataFrame:
    per_order = items.groupBy("order_id").agg(
        F.sum("item_gmv_eur").alias("item_gmv_eur"), F.sum("revenue_at_risk_eur").alias("item_risk_eur")
    )
    joined = orders.select("order_id", "gmv_eur", "revenue_at_risk_eur").join(per_order, "order_id")
    off = (F.abs(F.col("gmv_eur") - F.col("item_gmv_eur")) > tolerance) | (
        F.abs(F.col("revenue_at_risk_eur") - F.col("item_risk_eur")) > tolerance
    )
    return joined.where(off).select("order_id", "gmv_eur", "item_gmv_eur")
