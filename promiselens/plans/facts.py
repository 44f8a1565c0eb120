"""The star schema: order and item facts, date, product, seller and state dimensions.

``order_facts`` joins only the sources whose columns the caller asks for, so a query about lateness
never touches payments, reviews or coordinates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.functions import dates, geo, rules, text
from promiselens.operators.joins import lookup_join, measured, renamed
from promiselens.params import Params
from promiselens.plans import summaries, timeline

# Which source each column of the order fact needs beyond the order and its customer.
ITEM_COLUMNS = ["primary_seller_id", "item_count", "seller_count", "products_brl", "freight_brl", "gmv_brl",
                "late_cause", "seller_missed_ship_by", "seller_ship_by_at"]
PAYMENT_COLUMNS = ["main_payment_type", "max_installments", "used_voucher"]
REVIEW_COLUMNS = ["review_score", "is_low_review", "review_sent_date", "review_answered_at"]
CONTEXT_COLUMNS = ["weekday_holidays_first_10_days", "heavy_rain_days_first_7_days_transit",
                   "rain_mm_first_7_days_transit"]
NEEDS = {
    **dict.fromkeys(ITEM_COLUMNS, {"items"}),
    **dict.fromkeys(PAYMENT_COLUMNS, {"payments"}),
    **dict.fromkeys(REVIEW_COLUMNS, {"reviews"}),
    **dict.fromkeys(CONTEXT_COLUMNS, {"context"}),
    **dict.fromkeys(["seller_state", "route"], {"items", "seller"}),
    "seller_region": {"items", "seller", "regions"},
    "customer_region": {"regions"},
    **dict.fromkeys(["distance_km", "distance_band"], {"items", "seller", "zips"}),
    "brl_per_eur": {"fx"},
    **dict.fromkeys(["gmv_eur", "freight_eur", "late_gmv_eur"], {"items", "fx"}),
    "revenue_at_risk_reason": {"reviews"},
    "revenue_at_risk_eur": {"items", "fx", "reviews"},
}

ORDER_FACT_COLUMNS = [
    "order_id", "data_source", "is_synthetic", "sim_as_of", "customer_unique_id", "customer_city",
    "customer_state", "customer_region", "primary_seller_id", "seller_state", "seller_region", "route",
    "distance_km", "order_status", "delivery_outcome", "late_cause", "is_delivered", "is_late", "days_late",
    "purchased_at", "purchase_date", "approved_at", "shipped_at", "delivered_at", "shipped_date",
    "delivered_date", "promised_date", "promised_days", "actual_days", "approval_hours", "handover_days",
    "transit_days", "seller_missed_ship_by", "has_timestamp_anomaly", "main_payment_type", "max_installments",
    "used_voucher", "item_count", "seller_count", "products_brl", "freight_brl", "gmv_brl", "brl_per_eur",
    "gmv_eur", "freight_eur", "review_score", "is_low_review", "review_sent_date",
    "weekday_holidays_first_10_days", "heavy_rain_days_first_7_days_transit", "rain_mm_first_7_days_transit",
    "is_in_kpi_window", "distance_band", "revenue_at_risk_reason", "late_gmv_eur", "revenue_at_risk_eur",
]


def order_facts(feed, params: Params, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per order. ``columns`` (default: the whole fact) decides which sources are joined."""
    wanted = list(columns) if columns is not None else ORDER_FACT_COLUMNS
    needs: set[str] = set().union(*[NEEDS.get(name, set()) for name in wanted])

    orders = feed.orders
    if "items" in needs:
        orders = orders.join(summaries.items_summary(feed.items), "order_id", "left")
        zero = F.lit(0).cast("decimal(38,6)")
        for name in ("products_brl", "freight_brl", "gmv_brl"):
            orders = orders.withColumn(name, F.coalesce(name, zero))
        for name in ("item_count", "seller_count"):
            orders = orders.withColumn(name, F.coalesce(name, F.lit(0)))
    else:
        orders = orders.withColumn("seller_ship_by_at", F.lit(None).cast("timestamp_ntz"))
    if "payments" in needs:
        orders = orders.join(summaries.payments_summary(feed.payments).select("order_id", *PAYMENT_COLUMNS),
                             "order_id", "left")
    if "reviews" in needs:
        latest = summaries.latest_reviews(feed.reviews)
        orders = orders.join(
            latest.select("order_id", "review_score", "review_sent_date", "review_answered_at"), "order_id", "left"
        ).withColumn("is_low_review", F.col("review_score") <= params.low_review_max)

    facts = timeline.add_stages(orders, params)
    facts = lookup_join(facts, feed.customers, ["customer_id"], params, "inner", feed.orders, ["order_id"])
    facts = _add_places(facts, feed, params, needs)
    if "context" in needs:
        holidays = summaries.state_holidays(feed.holidays, feed.states)
        facts = timeline.add_context(facts, holidays, feed.weather, params)
    facts = facts.withColumn(
        "is_in_kpi_window",
        (F.col("data_source") == params.historical_source)
        & F.col("purchase_date").between(F.lit(params.kpi_start), F.lit(params.kpi_end)),
    )
    return _add_money(facts, feed, params, needs).select(*wanted)


def _add_places(facts: DataFrame, feed, params: Params, needs: set[str]) -> DataFrame:
    if "seller" in needs:
        sellers = renamed(
            feed.sellers, primary_seller_id="seller_id", seller_state="seller_state",
            seller_zip_prefix="seller_zip_prefix",
        )
        # An order's primary seller sold at least one of its items, so a seller hot here is hot there.
        sold = renamed(summaries.item_keys(feed), primary_seller_id="seller_id", order_id="order_id")
        facts = lookup_join(facts, sellers, ["primary_seller_id"], params, "left", sold, ["order_id"])
        facts = facts.withColumn("route", text.route_label("seller_state", "customer_state"))
    if "regions" in needs:
        for role in ["customer", "seller"] if "seller" in needs else ["customer"]:
            regions = renamed(feed.states, **{f"{role}_state": "state_code", f"{role}_region": "region"})
            facts = lookup_join(facts, regions, [f"{role}_state"], params)
    if "zips" in needs:
        centroids = measured(summaries.zip_centroids(feed.geolocation), params)
        for role in ("customer", "seller"):
            points = renamed(
                centroids, **{f"{role}_zip_prefix": "zip_prefix", f"_{role}_lat": "latitude", f"_{role}_lng": "longitude"}
            )
            facts = lookup_join(facts, points, [f"{role}_zip_prefix"], params)
        facts = facts.withColumn(
            "distance_km", geo.haversine_km("_seller_lat", "_seller_lng", "_customer_lat", "_customer_lng")
        ).withColumn("distance_band", rules.distance_band())
    return facts


def _add_money(facts: DataFrame, feed, params: Params, needs: set[str]) -> DataFrame:
    if "reviews" in needs:
        facts = facts.withColumn("revenue_at_risk_reason", rules.revenue_at_risk_reason())
    if "fx" in needs:
        # One row per calendar day: the size is arithmetic on the parameters, so broadcasting is safe.
        daily = summaries.fx_daily(feed.fx_rates, params)
        rates = F.broadcast(renamed(daily, purchase_date="rate_date", brl_per_eur="brl_per_eur"))
        facts = facts.join(rates, "purchase_date", "left")
    if {"fx", "items"} <= needs:
        for name in ("gmv", "freight"):
            facts = facts.withColumn(f"{name}_eur", F.col(f"{name}_brl").cast("double") / F.col("brl_per_eur"))
        late = F.col("delivery_outcome") == rules.LATE
        facts = facts.withColumn("late_gmv_eur", rules.amount_where(late, "gmv_eur"))
    if {"fx", "items", "reviews"} <= needs:
        at_risk = F.col("revenue_at_risk_reason").isNotNull()
        facts = facts.withColumn("revenue_at_risk_eur", rules.amount_where(at_risk, "gmv_eur"))
    return facts


ITEM_FACT_FROM_ORDER = [
    "order_id", "data_source", "is_synthetic", "customer_state", "purchase_date", "is_in_kpi_window", "shipped_at",
    "delivery_outcome", "is_delivered", "is_late", "days_late", "review_score", "is_low_review", "brl_per_eur",
    "revenue_at_risk_reason",
]


def item_facts(feed, params: Params, orders: DataFrame | None = None) -> DataFrame:
    """One row per item; the order's delivery result is copied to its items, the value is the item's own."""
    if orders is None:
        orders = order_facts(feed, params, ITEM_FACT_FROM_ORDER)
    line = ["order_id", "order_item_number"]
    sellers = feed.sellers.select("seller_id", "seller_state")
    items = lookup_join(feed.items, sellers, ["seller_id"], params, "left", summaries.item_keys(feed), line)
    joined = lookup_join(
        items, orders.select(*ITEM_FACT_FROM_ORDER), ["order_id"], params, "inner", summaries.item_keys(feed), line
    )
    value_brl = (F.col("price_brl") + F.col("freight_brl")).cast("decimal(38,6)")
    value_eur = F.col("item_gmv_brl").cast("double") / F.col("brl_per_eur")
    missed = F.when(F.col("shipped_at").isNotNull(), F.col("shipped_at") > F.col("shipping_limit_at"))
    return (
        joined.withColumn("order_item_key", text.row_key("order_id", "order_item_number"))
        .withColumn("seller_missed_ship_by", missed)
        .withColumn("item_gmv_brl", value_brl)
        .withColumn("item_gmv_eur", value_eur)
        .withColumn("late_gmv_eur", rules.amount_where(F.col("delivery_outcome") == rules.LATE, "item_gmv_eur"))
        .withColumn(
            "revenue_at_risk_eur", rules.amount_where(F.col("revenue_at_risk_reason").isNotNull(), "item_gmv_eur")
        )
        .select(
            "order_item_key", "order_id", "order_item_number", "data_source", "is_synthetic", "product_id",
            "seller_id", "seller_state", "customer_state", "purchase_date", "is_in_kpi_window", "shipping_limit_at",
            "shipped_at", "seller_missed_ship_by", "delivery_outcome", "is_delivered", "is_late", "days_late",
            "review_score", "is_low_review", "price_brl", "freight_brl", "item_gmv_brl", "brl_per_eur",
            "item_gmv_eur", "late_gmv_eur", "revenue_at_risk_eur",
        )
    )


def date_dimension(feed, params: Params) -> DataFrame:
    days = summaries.fx_daily(feed.fx_rates, params).withColumnRenamed("rate_date", "date_day")
    holidays = summaries.nationwide_holidays(feed.holidays).withColumnRenamed("holiday_date", "date_day")
    day, weekday = F.col("date_day"), dates.iso_weekday("date_day")
    return days.join(holidays, "date_day", "left").select(
        "date_day",
        F.year(day).alias("year_number"),
        F.quarter(day).alias("quarter_number"),
        F.month(day).alias("month_number"),
        dates.month_start(day).alias("month_start"),
        weekday.alias("iso_day_of_week"),
        F.coalesce("is_public_holiday", F.lit(False)).alias("is_public_holiday"),
        F.coalesce("is_bank_holiday", F.lit(False)).alias("is_bank_holiday"),
        "holiday_names",
        "brl_per_eur",
        "is_published_rate",
        day.between(F.lit(params.kpi_start), F.lit(params.kpi_end)).alias("is_in_kpi_window"),
        dates.year_month(day).alias("year_month"),
        dates.month_name(F.month(day)).alias("month_name"),
        dates.day_name(weekday).alias("day_name"),
        (weekday >= 6).alias("is_weekend"),
    )


def product_dimension(feed, params: Params) -> DataFrame:
    unknown = F.lit("unknown")
    translated = lookup_join(feed.products, feed.categories, ["category_name_pt"], params)
    return translated.select(
        "product_id",
        F.coalesce("category_name_pt", unknown).alias("category_name_pt"),
        F.coalesce("category_name_en", unknown).alias("category_name_en"),
        "photo_count",
        "weight_g",
        (F.col("length_cm") * F.col("height_cm") * F.col("width_cm")).alias("volume_cm3"),
        rules.weight_band().alias("weight_band"),
    )


def seller_dimension(feed, params: Params) -> DataFrame:
    regions = renamed(feed.states, seller_state="state_code", seller_region="region")
    centroids = renamed(
        summaries.zip_centroids(feed.geolocation), seller_zip_prefix="zip_prefix", latitude="latitude", longitude="longitude"
    )
    placed = lookup_join(feed.sellers, regions, ["seller_state"], params)
    placed = lookup_join(placed, centroids, ["seller_zip_prefix"], params)
    return placed.select(
        "seller_id", "seller_city", "seller_state", "seller_region", "seller_zip_prefix", "latitude", "longitude"
    )
