"""Stage times, outcome and cause of every order, and its holiday and rain exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.functions import dates, rules
from promiselens.functions.stats import count_where
from promiselens.operators.exposure import window_totals
from promiselens.operators.joins import lookup_join
from promiselens.params import Params


def order_timeline(orders: DataFrame, deadlines: DataFrame, params: Params) -> DataFrame:
    """``deadlines`` carries order_id and seller_ship_by_at (further columns pass through)."""
    joined = orders.join(deadlines, "order_id", "left")
    return add_stages(joined, params)


def add_stages(joined: DataFrame, params: Params) -> DataFrame:
    day = {name: F.col(f"{name}_at").cast("date") for name in ("purchased", "shipped", "delivered")}
    prepared = joined.withColumns(
        {
            "purchase_date": day["purchased"],
            "shipped_date": day["shipped"],
            "delivered_date": day["delivered"],
            "is_delivered": (F.col("order_status") == "delivered") & F.col("delivered_at").isNotNull(),
            "has_timestamp_anomaly": rules.timestamp_anomaly(),
        }
    ).withColumn("is_late_delivery", F.col("is_delivered") & (F.col("delivered_date") > F.col("promised_date")))
    delivered, late = F.col("is_delivered"), F.col("is_late_delivery")
    plausible = ~F.col("has_timestamp_anomaly")
    return prepared.withColumns(
        {
            "promised_days": dates.days_between("purchase_date", "promised_date"),
            "actual_days": F.when(delivered, dates.days_between("purchase_date", "delivered_date")),
            "is_late": F.when(delivered, late),
            "days_late": F.when(late, dates.days_between("promised_date", "delivered_date")).otherwise(0),
            "approval_hours": dates.hours_between("purchased_at", "approved_at"),
            "handover_days": F.when(plausible, dates.hours_between("approved_at", "shipped_at") / 24),
            "transit_days": F.when(plausible, dates.hours_between("shipped_at", "delivered_at") / 24),
            "seller_missed_ship_by": F.when(
                F.col("shipped_at").isNotNull(), F.col("shipped_at") > F.col("seller_ship_by_at")
            ),
            "delivery_outcome": rules.delivery_outcome(params.data_cutoff),
            "late_cause": rules.late_cause(),
        }
    ).drop("is_late_delivery")


def holiday_windows(state_holidays: DataFrame, params: Params) -> DataFrame:
    """Per state and purchase day: weekday holidays in the window that starts on that day."""
    return window_totals(
        state_holidays.where("is_weekday"),
        "state_code",
        "holiday_date",
        params.holiday_window_days,
        _holidays=F.count("holiday_date"),
    )


def rain_windows(weather: DataFrame, params: Params) -> DataFrame:
    """Per state and hand-over day: heavy-rain days and rain in the window that starts on that day."""
    return window_totals(
        weather,
        "state_code",
        "weather_date",
        params.rain_window_days,
        _heavy=count_where(F.col("precipitation_mm") >= params.heavy_rain_mm),
        _rain=F.sum("precipitation_mm"),
    )


def add_context(orders: DataFrame, holidays: DataFrame, weather: DataFrame, params: Params) -> DataFrame:
    """Adds the exposure columns to rows with order_id, customer_state, purchase_date, shipped_date.

    No matching holiday is 0 holidays. No matching weather row is 0 heavy-rain days but unknown rain;
    an order that was not handed over has neither.
    """
    keyed = orders.withColumns({"_state": F.col("customer_state"), "_start_day": F.col("purchase_date")})
    on = ["_state", "_start_day"]
    with_holidays = lookup_join(keyed, holiday_windows(holidays, params), on, params).withColumn(
        "_start_day", F.col("shipped_date")
    )
    with_rain = lookup_join(with_holidays, rain_windows(weather, params), on, params)
    shipped = F.col("shipped_date").isNotNull()
    return with_rain.withColumns(
        {
            "weekday_holidays_first_10_days": F.coalesce("_holidays", F.lit(0)),
            "heavy_rain_days_first_7_days_transit": F.when(shipped, F.coalesce("_heavy", F.lit(0))),
            "rain_mm_first_7_days_transit": F.when(shipped, F.col("_rain")),
        }
    ).drop("_state", "_start_day", "_holidays", "_heavy", "_rain")


def order_context(
    orders: DataFrame, customers: DataFrame, holidays: DataFrame, weather: DataFrame, params: Params
) -> DataFrame:
    placed = lookup_join(
        orders.select(
            "order_id",
            "customer_id",
            F.col("purchased_at").cast("date").alias("purchase_date"),
            F.col("shipped_at").cast("date").alias("shipped_date"),
        ),
        customers.select("customer_id", "customer_state"),
        ["customer_id"],
        params,
        "inner",
        orders,
        ["order_id"],
    )
    return add_context(placed, holidays, weather, params).select(
        "order_id",
        "weekday_holidays_first_10_days",
        "heavy_rain_days_first_7_days_transit",
        "rain_mm_first_7_days_transit",
    )
