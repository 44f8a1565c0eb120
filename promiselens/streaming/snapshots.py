"""As-of views and snapshot differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promiselens.functions.stats import count_where


def _moment(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def _happened(column: str, moment: Column) -> Column:
    return F.when(F.col(column) <= moment, F.col(column))


def status_at(moment: Column) -> Column:
    """Status of a planned order at a moment; the first rule that has happened wins."""

    def seen(column: str) -> Column:
        return F.coalesce(F.col(column) <= moment, F.lit(False))

    fresh = moment < F.col("approved_at") + F.expr("interval 12 hours")
    after_approval = F.when(fresh, "approved").when(F.col("is_stuck"), "processing").otherwise("invoiced")
    return (
        F.when(seen("canceled_at"), "canceled")
        .when(seen("unavailable_at"), "unavailable")
        .when(seen("delivered_at"), "delivered")
        .when(seen("shipped_at"), "shipped")
        .when(seen("approved_at"), after_approval)
        .otherwise("created")
    )


def orders_as_of(planned: DataFrame, as_of: datetime) -> DataFrame:
    """Orders bought by ``as_of`` with everything later masked."""
    moment = _moment(as_of)
    return planned.where(F.col("purchased_at") <= moment).select(
        "order_id",
        "customer_id",
        status_at(moment).alias("order_status"),
        "purchased_at",
        *[_happened(c, moment).alias(c) for c in ("approved_at", "shipped_at", "delivered_at")],
        "promised_date",
        moment.alias("sim_as_of"),
    )


def reviews_as_of(reviews: DataFrame, as_of: datetime) -> DataFrame:
    return reviews.where(F.col("review_answered_at") <= _moment(as_of))


def snapshot_diff(
    before: DataFrame, after: DataFrame, reviews_before: DataFrame, reviews_after: DataFrame
) -> DataFrame:
    """One row: totals of the later snapshot and what changed since the earlier one."""
    earlier = before.select("order_id", F.col("order_status").alias("_was"))
    joined = after.join(earlier, "order_id", "left")
    now, was = F.col("order_status"), F.col("_was")
    counts = joined.agg(
        F.max("sim_as_of").alias("sim_as_of"),
        F.count(F.lit(1)).alias("orders_total"),
        count_where(was.isNull()).alias("new_orders"),
        count_where(was != now).alias("orders_changed_status"),
        count_where((now == "delivered") & (was != "delivered")).alias("newly_delivered"),
        count_where(now == "shipped").alias("in_transit"),
        count_where(now == "delivered").alias("delivered_total"),
    )
    reviews_now = reviews_after.agg(F.count(F.lit(1))).scalar()
    reviews_then = reviews_before.agg(F.count(F.lit(1))).scalar()
    previous = before.agg(F.max("sim_as_of")).scalar()
    return counts.withColumns(
        {
            "previous_sim_as_of": previous,
            "days_covered": F.datediff(F.col("sim_as_of").cast("date"), previous.cast("date")),
            "reviews_total": reviews_now,
            "new_reviews": reviews_now - reviews_then,
        }
    )
