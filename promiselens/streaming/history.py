"""Interval-encoded history: every state of a row with the moments it is valid from and to.

A view of any moment is a range filter on a stored history: ``valid_from <= T < valid_to``. The stored form is partitioned
by the month in which a state ended, states that still hold being one more partition, and sorted by ``valid_from`` inside:
a recent moment opens the partitions of later months only, and row groups that begin after it are skipped.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promiselens.operators.joins import lookup_join
from promiselens.params import Params
from promiselens.plans.summaries import item_keys
from promiselens.streaming.snapshots import _happened, _moment, status_at

OPEN = "9999-12-31 00:00:00"
OPEN_MONTH = OPEN[:7]
EVENTS = ("approved_at", "shipped_at", "delivered_at")


def _open() -> Column:
    return F.lit(OPEN).cast("timestamp_ntz")


def order_history(planned: DataFrame) -> DataFrame:
    """One row per state of a planned order: what a view shows from ``valid_from`` until just before ``valid_to``.

    A view of an order changes only when one of its events happens, or twelve hours after its approval. Events dated before the purchase
    are seen from the purchase on. An order without a purchase time is in no view.
    """
    half_day = F.col("approved_at") + F.expr("interval 12 hours")
    moments = F.array("purchased_at", *EVENTS, half_day, "canceled_at", "unavailable_at")
    later = F.filter(F.array_distinct(moments), lambda at: at >= F.col("purchased_at"))
    changes = planned.withColumn("_at", F.array_sort(later)).select(
        "*", F.posexplode("_at").alias("_n", "valid_from"), F.size("_at").alias("_count")
    )
    until = F.when(F.col("_n") + 1 < F.col("_count"), F.get("_at", F.col("_n") + 1)).otherwise(_open())
    moment = F.col("valid_from")
    return changes.select(
        "order_id", "customer_id", status_at(moment).alias("order_status"), "purchased_at",
        *[_happened(c, moment).alias(c) for c in EVENTS], "promised_date", "valid_from", until.alias("valid_to"),
    )


def since(rows: DataFrame, starts: str) -> DataFrame:
    """Rows that never change once they are there: valid from ``starts`` on; rows without that time are in no view."""
    known = rows.where(F.col(starts).isNotNull())
    return known.withColumns({"valid_from": F.col(starts), "valid_to": _open()})


def since_order(rows: DataFrame, orders: DataFrame, params: Params, key_source: DataFrame, spread_by: list[str]) -> DataFrame:
    """Rows of an order (items, payments), there from its purchase on; rows without an order are in no view."""
    bought = orders.select("order_id", F.col("purchased_at").alias("_bought"))
    return since(lookup_join(rows, bought, ["order_id"], params, "inner", key_source, spread_by), "_bought").drop("_bought")


def since_first_order(customers: DataFrame, orders: DataFrame, params: Params) -> DataFrame:
    """Customers, there from their first purchase on."""
    first = orders.groupBy("customer_id").agg(F.min("purchased_at").alias("_first"))
    return since(lookup_join(customers, first, ["customer_id"], params, "inner", customers, ["customer_id"]), "_first").drop("_first")


def stored_form(history: DataFrame) -> DataFrame:
    """The shape a history is written in: partition column and order of rows."""
    month = F.date_format("valid_to", "yyyy-MM").alias("until_month")
    return history.select("*", month).hint("rebalance", "until_month").sortWithinPartitions("until_month", "valid_from")


def histories(feed, params: Params) -> dict[str, DataFrame]:
    """The histories of all five tables of the live feed. ``feed.planned_orders`` holds the orders with all their events."""
    planned = feed.planned_orders
    return {
        "orders": order_history(planned),
        "items": since_order(feed.items, planned, params, item_keys(feed), ["order_item_number", "product_id"]),
        "payments": since_order(feed.payments, planned, params, feed.payments, ["payment_sequence"]),
        "reviews": since(feed.reviews, "review_answered_at"),
        "customers": since_first_order(feed.customers, planned, params),
    }


def as_of(history: DataFrame, moment: datetime) -> DataFrame:
    """What a stored history holds at ``moment``: a range filter; months that ended before are not opened."""
    at = _moment(moment)
    valid = (F.col("valid_from") <= at) & (F.col("valid_to") > at)
    ended_later = F.col("until_month") >= f"{moment:%Y-%m}"
    return history.where(ended_later & valid).drop("valid_from", "valid_to", "until_month").withColumn("sim_as_of", at)
