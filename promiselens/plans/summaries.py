"""One row per order from items, payments and reviews; zip centroids; daily rates; state holidays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.functions import dates
from promiselens.functions.order import nulls_last
from promiselens.operators.calendars import calendar_days, forward_filled
from promiselens.params import Params


def item_keys(feed) -> DataFrame:
    """Order, number, product and seller of the items, from the cheapest frame that the feed has."""
    return feed.item_keys if hasattr(feed, "item_keys") else feed.items


def items_summary(items: DataFrame) -> DataFrame:
    """Totals, latest deadline and primary seller of each order.

    Two aggregations, both with map-side combine: first per (order, seller), so an order or a seller
    with very many items shrinks before any row moves; then per order. The primary seller sells the most
    by value, the smallest id winning a tie.
    """
    per_seller = items.groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("_items"),
        F.sum("price_brl").alias("_products"),
        F.sum("freight_brl").alias("_freight"),
        F.max("shipping_limit_at").alias("_deadline"),
    )
    money = "decimal(38,6)"
    first = F.min_by("seller_id", nulls_last(-F.col("_products"), "seller_id"))
    return (
        per_seller.groupBy("order_id")
        .agg(
            F.sum("_items").alias("item_count"),
            F.count("seller_id").alias("seller_count"),
            F.sum("_products").cast(money).alias("products_brl"),
            F.sum("_freight").cast(money).alias("freight_brl"),
            F.max("_deadline").alias("seller_ship_by_at"),
            first.alias("primary_seller_id"),
        )
        .withColumn("gmv_brl", (F.col("products_brl") + F.col("freight_brl")).cast(money))
    )


def payments_summary(payments: DataFrame) -> DataFrame:
    """Main payment type = the largest payment, the earliest winning a tie; an unknown value or place comes last."""
    order = nulls_last(-F.col("payment_brl"), "payment_sequence", "payment_type")
    return payments.groupBy("order_id").agg(
        F.min_by("payment_type", order).alias("main_payment_type"),
        F.count(F.lit(1)).alias("payment_count"),
        F.sum("payment_brl").alias("paid_brl"),
        F.max("installments").alias("max_installments"),
        F.bool_or(F.coalesce(F.col("payment_type") == "voucher", F.lit(False))).alias("used_voucher"),
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The latest answer of each order, unknown times last; ties go to the later sending, then the smallest id."""
    newest_first = nulls_last(
        -F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("review_answered_at")),
        -F.unix_date("review_sent_date"),
        "review_id",
    )
    kept = ["review_id", "review_score", "has_comment", "review_sent_date", "review_answered_at"]
    return (
        reviews.groupBy("order_id")
        .agg(F.min_by(F.struct(*kept), newest_first).alias("_latest"), F.count(F.lit(1)).alias("reviews_for_order"))
        .select("order_id", *[F.col(f"_latest.{name}").alias(name) for name in kept], "reviews_for_order")
    )


def zip_centroids(geolocation: DataFrame) -> DataFrame:
    return geolocation.where("is_inside_brazil").groupBy("zip_prefix").agg(
        F.avg("latitude").alias("latitude"),
        F.avg("longitude").alias("longitude"),
        F.count(F.lit(1)).alias("point_count"),
    )


def fx_daily(fx_rates: DataFrame, params: Params) -> DataFrame:
    """One rate per calendar day; days before the first published rate stay empty."""
    days = calendar_days(fx_rates.sparkSession, params.calendar_start, params.last_calendar_day, "rate_date")
    return forward_filled(days, fx_rates, "rate_date", "brl_per_eur", "is_published_rate")


def _merged(holidays: DataFrame, *keys: str) -> DataFrame:
    """One row per key: names joined in order, flags or-ed. A key has a handful of holidays."""
    return holidays.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list("holiday_name")), " / ").alias("holiday_names"),
        F.bool_or("is_public_holiday").alias("is_public_holiday"),
        F.bool_or("is_bank_holiday").alias("is_bank_holiday"),
    )


def state_holidays(holidays: DataFrame, states: DataFrame) -> DataFrame:
    """Holidays of every state: nationwide ones for all states, regional ones by their state codes.

    No cross join with an OR: each holiday lists its states (all of them when nationwide) and the list is
    exploded. The state codes are one small array from a scalar subquery.
    """
    codes = states.agg(F.array_agg(F.concat(F.lit("BR-"), "state_code"))).scalar()
    listed = F.when(F.col("is_nationwide"), codes).otherwise(F.array_distinct("state_iso_codes"))
    per_state = (
        holidays.withColumn("_code", F.explode(listed))
        .where(F.array_contains(codes, F.col("_code")))
        .withColumn("state_code", F.substring_index("_code", "-", -1))
    )
    return _merged(per_state, "state_code", "holiday_date").withColumn(
        "is_weekday", dates.iso_weekday("holiday_date") <= 5
    )


def nationwide_holidays(holidays: DataFrame) -> DataFrame:
    return _merged(holidays.where("is_nationwide"), "holiday_date")
