"""Profile of the typed tables: counts, oddities and extents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.functions import dates
from promiselens.functions.stats import count_where
from promiselens.operators.joins import lookup_join
from promiselens.params import Params

DAY_SECONDS = 86_400


def _rows(name: str):
    return F.count(F.lit(1)).alias(name)


def table_rows(tables: dict[str, DataFrame], synthetic: set[str] = frozenset()) -> DataFrame:
    """Rows per table; each branch is a count, which reads file footers only."""
    parts = [
        df.agg(_rows("rows")).select(F.lit(name + (" (SYNTHETIC)" if name in synthetic else "")).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def status_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("order_status").alias("status")).agg(
        _rows("orders"), F.count("delivered_at").alias("with_delivery_date")
    )


def orders_per_month(orders: DataFrame) -> DataFrame:
    return orders.groupBy(dates.year_month("purchased_at").alias("month")).agg(_rows("orders"))


def impossible_timestamps(orders: DataFrame) -> DataFrame:
    shipped, delivered = F.col("shipped_at"), F.col("delivered_at")
    return orders.where("order_status = 'delivered'").agg(
        count_where(shipped < F.col("purchased_at")).alias("handed_over_before_purchase"),
        count_where(shipped < F.col("approved_at")).alias("handed_over_before_approval"),
        count_where(delivered < shipped).alias("delivered_before_hand_over"),
        count_where(delivered.isNull()).alias("delivered_without_date"),
    )


def lateness_by_date_or_time(orders: DataFrame) -> DataFrame:
    day, promised = F.col("delivered_at").cast("date"), F.col("promised_date")
    return orders.where("order_status = 'delivered' and delivered_at is not null").agg(
        count_where(day > promised).alias("late_by_date"),
        count_where(F.col("delivered_at") > promised.cast("timestamp_ntz")).alias("late_by_timestamp"),
        count_where(day == promised).alias("delivered_on_promised_day"),
    )


def review_multiplicity(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews are counted per order once; every figure follows from those counts."""
    per_order = reviews.groupBy("order_id").agg(_rows("_reviews"))
    unreviewed = orders.join(per_order, "order_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    return per_order.agg(
        F.coalesce(F.sum("_reviews"), F.lit(0)).alias("review_rows"),
        F.count(F.lit(1)).alias("orders_reviewed"),
        count_where(F.col("_reviews") > 1).alias("orders_with_several_reviews"),
    ).withColumn("orders_without_review", unreviewed)


def payments_by_type(payments: DataFrame) -> DataFrame:
    """Per (type, order) first, so counting distinct orders needs no wide set per type."""
    per_order = payments.groupBy("payment_type", "order_id").agg(
        _rows("_payments"), F.sum("payment_brl").alias("_brl")
    )
    return per_order.groupBy("payment_type").agg(
        F.sum("_payments").alias("payments"), _rows("orders"), F.round(F.sum("_brl"), 0).alias("brl")
    )


def payments_match_items(items: DataFrame, payments: DataFrame, cent: str = "0.01") -> DataFrame:
    owed = items.groupBy("order_id").agg(F.sum(F.col("price_brl") + F.col("freight_brl")).alias("_owed"))
    paid = payments.groupBy("order_id").agg(F.sum("payment_brl").alias("_paid"))
    difference, tolerance = F.col("_paid") - F.col("_owed"), F.lit(cent).cast("decimal(10,6)")
    return owed.join(paid, "order_id").agg(
        _rows("orders_with_both"),
        count_where(F.abs(difference) <= tolerance).alias("match_to_the_cent"),
        count_where(difference > tolerance).alias("paid_more"),
        count_where(difference < -tolerance).alias("paid_less"),
    )


def customers_and_people(customers: DataFrame) -> DataFrame:
    per_person = customers.groupBy("customer_unique_id").agg(
        _rows("_ids"), count_where(F.col("customer_zip_prefix").startswith("0")).alias("_zero")
    )
    return per_person.agg(
        F.sum("_ids").alias("customer_ids"),
        F.count("customer_unique_id").alias("people"),
        count_where(F.col("_ids") > 1).alias("people_with_several_orders"),
        F.sum("_zero").alias("zip_prefixes_with_leading_zero"),
    )


def deadline_anchor(orders: DataFrame, items: DataFrame, params: Params) -> DataFrame:
    """Does the seller's deadline lie whole days after the approval or after the purchase?"""
    stamped = orders.where("approved_at is not null").select("order_id", "purchased_at", "approved_at")
    gaps = lookup_join(
        items.select("order_id", "order_item_number", "shipping_limit_at"),
        stamped, ["order_id"], params, "inner", items, ["order_item_number"],
    ).select(
        dates.seconds_between("approved_at", "shipping_limit_at").alias("_approval"),
        dates.seconds_between("purchased_at", "shipping_limit_at").alias("_purchase"),
    )

    def whole(column: str):
        return F.pmod(F.col(column), F.lit(DAY_SECONDS)) == 0

    def percent(column: str):
        return F.round(F.lit(100.0) * count_where(whole(column)) / F.count(F.lit(1)), 1)

    days = F.floor(F.col("_approval") / DAY_SECONDS)
    return gaps.agg(
        _rows("items"),
        percent("_approval").alias("pct_exact_days_after_approval"),
        percent("_purchase").alias("pct_exact_days_after_purchase"),
        F.mode(F.when(whole("_approval"), days)).alias("most_common_days"),
    )


def multi_seller_orders(items: DataFrame) -> DataFrame:
    pairs = items.groupBy("order_id", "seller_id").agg(_rows("_items")).where(F.col("seller_id").isNotNull())
    return pairs.groupBy("order_id").agg(_rows("_sellers")).where("_sellers > 1").agg(_rows("orders"))


def product_categories(products: DataFrame, categories: DataFrame) -> DataFrame:
    used = products.where(F.col("category_name_pt").isNotNull()).select("category_name_pt").distinct()
    missing = used.join(categories, "category_name_pt", "left_anti").agg(F.count(F.lit(1))).scalar()
    return products.agg(
        _rows("products"), count_where(F.col("category_name_pt").isNull()).alias("without_category")
    ).withColumn("categories_missing_translation", missing)


def geolocation_outliers(points: DataFrame) -> DataFrame:
    per_zip = points.groupBy("zip_prefix").agg(
        _rows("_points"), count_where(~F.col("is_inside_brazil")).alias("_outside")
    )
    return per_zip.agg(
        F.sum("_points").alias("points"),
        F.count("zip_prefix").alias("zip_prefixes"),
        F.sum("_outside").alias("points_outside_brazil"),
    )


def series_extents(series: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [
        df.agg(
            _rows("records"), F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last")
        ).select(F.lit(name).alias("source"), "records", "first", "last")
        for name, (df, day) in series.items()
    ]
    return reduce(DataFrame.unionByName, parts)
