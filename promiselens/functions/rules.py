"""The delivery rules as expressions: outcome, cause, bands, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels result tables are keyed by.
ON_TIME = "On time"
LATE = "Late"
CANCELLED = "Cancelled"
DATE_MISSING = "Delivered, date missing"
OVERDUE = "Overdue, not delivered"
OPEN = "Open, not yet due"
CAUSE_UNCLEAR = "Unclear (timestamp issue)"
CAUSE_SELLER = "Seller shipped late"
CAUSE_AFTER = "After hand-over (carrier or promise)"
RISK_LATE = "Late and rated 1-2 stars"
RISK_OVERDUE = "Overdue, never delivered"
ORDER_STATUSES = [
    "delivered", "shipped", "canceled", "unavailable", "invoiced", "processing", "created", "approved",
]
CLOSED_WITHOUT_DELIVERY = ["canceled", "unavailable"]
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card", "not_defined"]


def band(column: str, edges: list[tuple[float, str]], last: str, unknown: str | None = None) -> Column:
    """Label of the first ``value < edge``; ``unknown`` is the label of a null."""
    value = F.col(column)
    chain = F.when(value.isNull(), unknown) if unknown is not None else None
    for edge, label in edges:
        chain = F.when(value < edge, label) if chain is None else chain.when(value < edge, label)
    return chain.otherwise(last)


def weight_band(column: str = "weight_g") -> Column:
    edges = [(500, "1: under 0.5 kg"), (2000, "2: 0.5-2 kg"), (10000, "3: 2-10 kg")]
    return band(column, edges, "4: over 10 kg", "Unknown")


def distance_band(column: str = "distance_km") -> Column:
    edges = [(250, "1: under 250 km"), (750, "2: 250-750 km"), (1500, "3: 750-1,500 km")]
    return band(column, edges, "4: over 1,500 km", "Unknown")


def days_late_band(column: str = "days_late") -> Column:
    edges = [(1, "0: on time"), (3, "1: 1-2 days"), (8, "2: 3-7 days"), (15, "3: 8-14 days")]
    return band(column, edges, "4: over 14 days")


def timestamp_anomaly() -> Column:
    """Any two stages recorded in an impossible order; missing stages are no evidence."""
    shipped = F.col("shipped_at")
    found = (
        (shipped < F.col("purchased_at")) | (shipped < F.col("approved_at")) | (F.col("delivered_at") < shipped)
    )
    return F.coalesce(found, F.lit(False))


def delivery_outcome(cutoff) -> Column:
    """Needs is_delivered, is_late_delivery. Order matters: each rule assumes the earlier ones failed."""
    judged_on = F.coalesce(F.col("sim_as_of").cast("date"), F.lit(cutoff))
    return (
        F.when(F.col("is_late_delivery"), LATE)
        .when(F.col("is_delivered"), ON_TIME)
        .when(F.col("order_status").isin(CLOSED_WITHOUT_DELIVERY), CANCELLED)
        .when(F.col("order_status") == "delivered", DATE_MISSING)
        .when(F.col("promised_date") < judged_on, OVERDUE)
        .otherwise(OPEN)
    )


def late_cause() -> Column:
    shipped, deadline = F.col("shipped_at"), F.col("seller_ship_by_at")
    unclear = F.col("has_timestamp_anomaly") | shipped.isNull() | deadline.isNull()
    return F.when(
        F.col("is_late_delivery"),
        F.when(unclear, CAUSE_UNCLEAR).when(shipped > deadline, CAUSE_SELLER).otherwise(CAUSE_AFTER),
    )


def revenue_at_risk_reason() -> Column:
    """A broken promise with evidence of damage. An unreviewed late order is no evidence."""
    outcome = F.col("delivery_outcome")
    return F.when((outcome == LATE) & F.col("is_low_review"), RISK_LATE).when(outcome == OVERDUE, RISK_OVERDUE)


def amount_where(condition: Column, amount) -> Column:
    """The amount when the condition holds, else 0 (a missing amount stays missing)."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.when(condition, amount).otherwise(F.lit(0.0))


def review_bucket() -> Column:
    outcome, late = F.col("delivery_outcome"), F.col("days_late")
    return (
        F.when(outcome == ON_TIME, "on_time")
        .when((outcome == LATE) & (late <= 2), "late_1_2_days")
        .when((outcome == LATE) & (late <= 7), "late_3_7_days")
        .when((outcome == LATE) & (late <= 14), "late_8_14_days")
        .when(outcome == LATE, "late_over_14_days")
        .when(outcome == OVERDUE, "never_delivered")
        .when(outcome == CANCELLED, "cancelled")
    )
