"""Result tables over the facts: months, routes, sellers, late drivers, live days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.functions import dates, rules
from promiselens.functions.stats import avg_where, count_where, discrete_percentile, safe_ratio
from promiselens.operators.passes import materialise_in_passes
from promiselens.operators.ranking import add_global_rank
from promiselens.params import Params

MONTHLY_NEEDS = ["purchase_date", "is_in_kpi_window", "is_delivered", "is_late", "delivery_outcome", "gmv_eur",
                 "late_gmv_eur", "revenue_at_risk_eur", "promised_days", "actual_days", "review_score"]
ROUTE_NEEDS = ["route", "seller_state", "customer_state", "is_in_kpi_window", "is_delivered", "is_late",
               "distance_km", "promised_days", "actual_days", "gmv_eur", "late_gmv_eur",
               "revenue_at_risk_eur"]
LIVE_NEEDS = ["purchase_date", "is_synthetic", "sim_as_of", "is_delivered", "is_late", "delivery_outcome",
              "gmv_eur", "revenue_at_risk_eur", "review_score"]
SELLER_NEEDS = ["seller_id", "seller_state", "order_id", "is_in_kpi_window", "is_delivered", "is_late",
                "seller_missed_ship_by", "review_score", "item_gmv_eur", "late_gmv_eur", "revenue_at_risk_eur"]
DRIVER_NEEDS = ["customer_state", "seller_state", "purchase_date", "shipped_date", "is_in_kpi_window",
                "is_delivered", "is_late", "promised_days", "actual_days", "seller_missed_ship_by",
                "main_payment_type", "weekday_holidays_first_10_days", "heavy_rain_days_first_7_days_transit",
                "distance_km"]


def _value_sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in ("gmv_eur", "late_gmv_eur", "revenue_at_risk_eur")]


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("orders"),
        count_where(F.col("is_delivered")).alias("delivered_orders"),
        count_where(F.col("is_late")).alias("late_orders"),
    ]


def _days() -> list[Column]:
    return [
        avg_where(F.col("is_delivered"), "promised_days").alias("avg_promised_days"),
        F.avg("actual_days").alias("avg_actual_days"),
    ]


def _trailing(rows: int, order: str) -> Window:
    return Window.orderBy(order).rowsBetween(1 - rows, Window.currentRow)


def monthly_kpis(orders: DataFrame) -> DataFrame:
    """One row per month of the KPI window; the un-keyed windows run over months only."""
    months = (
        orders.where("is_in_kpi_window")
        .groupBy(dates.month_start("purchase_date").alias("month_start"))
        .agg(
            *_counts(),
            count_where(F.col("delivery_outcome") == rules.OVERDUE).alias("overdue_orders"),
            *_value_sums(),
            *_days(),
            F.avg("review_score").alias("avg_review_score"),
        )
    )
    three = _trailing(3, "month_start")
    rate = safe_ratio("late_orders", "delivered_orders")
    return months.select(
        "month_start",
        "orders",
        "delivered_orders",
        "late_orders",
        "overdue_orders",
        rate.alias("late_rate"),
        (1 - rate).alias("on_time_rate"),
        safe_ratio(F.sum("late_orders").over(three), F.sum("delivered_orders").over(three)).alias(
            "late_rate_rolling_3m"
        ),
        "gmv_eur",
        (F.col("gmv_eur") - F.lag("gmv_eur").over(Window.orderBy("month_start"))).alias(
            "gmv_eur_change_vs_prior_month"
        ),
        "late_gmv_eur",
        "revenue_at_risk_eur",
        safe_ratio("revenue_at_risk_eur", "gmv_eur").alias("revenue_at_risk_share"),
        "avg_promised_days",
        "avg_actual_days",
        (F.col("avg_promised_days") - F.col("avg_actual_days")).alias("avg_buffer_days"),
        "avg_review_score",
    )


def route_performance(orders: DataFrame, params: Params) -> DataFrame:
    """One row per seller state -> customer state. There are at most states x states routes, so the
    ranking windows see a bounded table."""
    routes = (
        orders.where(F.col("is_in_kpi_window") & F.col("seller_state").isNotNull())
        .groupBy("route", "seller_state", "customer_state")
        .agg(
            *_counts(),
            F.avg("distance_km").alias("avg_distance_km"),
            *_days(),
            discrete_percentile("actual_days", 0.9).cast("int").alias("p90_actual_days"),
            *_value_sums(),
        )
        .withColumn("late_rate", safe_ratio("late_orders", "delivered_orders"))
        .withColumn("avg_buffer_days", F.col("avg_promised_days") - F.col("avg_actual_days"))
        .withColumn("is_rankable", F.col("delivered_orders") >= params.min_orders_for_ranking)
    )

    def rank_by(value: str) -> Column:
        among = Window.partitionBy("is_rankable").orderBy(F.col(value).desc_nulls_last())
        return F.when(F.col("is_rankable"), F.rank().over(among))

    biggest_first = Window.orderBy(F.col("revenue_at_risk_eur").desc_nulls_last(), "route")
    so_far = biggest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("revenue_at_risk_eur").over(Window.partitionBy())
    return routes.withColumns(
        {
            "revenue_at_risk_rank": rank_by("revenue_at_risk_eur"),
            "late_rate_rank": rank_by("late_rate"),
            "share_of_revenue_at_risk": safe_ratio("revenue_at_risk_eur", total),
            "cumulative_share_of_revenue_at_risk": safe_ratio(F.sum("revenue_at_risk_eur").over(so_far), total),
        }
    )


def seller_totals(items: DataFrame) -> DataFrame:
    """Per (seller, order), so a delivery result counts once per seller; then per seller."""
    per_order = (
        items.where("is_in_kpi_window")
        .groupBy("seller_id", "seller_state", "order_id")
        .agg(
            F.bool_or("is_delivered").alias("is_delivered"),
            F.bool_or(F.coalesce("is_late", F.lit(False))).alias("is_late"),
            F.bool_or(F.coalesce("seller_missed_ship_by", F.lit(False))).alias("missed"),
            (F.count("seller_missed_ship_by") > 0).alias("has_result"),
            F.max("review_score").alias("review_score"),
            F.sum("item_gmv_eur").alias("gmv_eur"),
            F.sum("late_gmv_eur").alias("late_gmv_eur"),
            F.sum("revenue_at_risk_eur").alias("revenue_at_risk_eur"),
        )
    )
    return per_order.groupBy("seller_id", "seller_state").agg(
        *_counts(),
        safe_ratio(F.count_if("missed"), F.count_if("has_result")).alias("missed_ship_by_rate"),
        F.avg("review_score").alias("avg_review_score"),
        *_value_sums(),
    )


def seller_performance(items: DataFrame, params: Params) -> DataFrame:
    """One row per seller. Sellers are unbounded, so the ranks are computed without a one-task window
    and the platform rate is a one-row aggregate. The totals feed four branches: they are written once."""
    totals = materialise_in_passes(seller_totals(items), ["seller_id"], params)
    platform = totals.agg(safe_ratio(F.sum("late_orders"), F.sum("delivered_orders")).alias("_rate"))
    scored = totals.withColumns(
        {
            "late_rate": safe_ratio("late_orders", "delivered_orders"),
            "platform_late_rate": platform.scalar(),
            "is_rankable": F.col("delivered_orders") >= params.min_orders_for_ranking,
        }
    )
    rankable = F.col("is_rankable")
    ranked = scored.withColumns(
        {"_risk": F.when(rankable, F.col("revenue_at_risk_eur")), "_late": F.when(rankable, F.col("late_rate"))}
    )
    ranked = add_global_rank(ranked, "_risk", "_risk_rank", ["seller_id"], params, descending=True)
    ranked = add_global_rank(ranked, "_late", "_late_rank", ["seller_id"], params, percent=True)
    watch = rankable & (F.col("late_rate") >= params.watchlist_factor * F.col("platform_late_rate"))
    return ranked.withColumns(
        {
            "revenue_at_risk_rank": F.when(rankable, F.col("_risk_rank")),
            "late_rate_percentile": F.when(rankable, F.col("_late_rank")),
            "is_on_watchlist": watch,
        }
    ).drop("_risk", "_late", "_risk_rank", "_late_rank")


# The conditions compared, in the order the table lists them.
DRIVERS = [
    ("Seller shipped after its deadline", "seller_missed_ship_by", "purchase_date"),
    ("Seller in another state", "seller_state <> customer_state", "purchase_date"),
    ("Distance over 1,000 km", "distance_km > {far_km}", "purchase_date"),
    ("Heavy rain at destination, first 7 days of transit", "heavy_rain_days_first_7_days_transit > 0", "shipped_date"),
    ("Paid by boleto (bank slip)", "main_payment_type = 'boleto'", "purchase_date"),
    ("Weekday holiday in the first 10 days", "weekday_holidays_first_10_days > 0", "purchase_date"),
]


def late_drivers(orders: DataFrame, params: Params) -> DataFrame:
    """Late rate with and without each condition, raw and compared inside (state, week) strata.

    The fact is read once: each order emits one small row per driver, and map-side combine reduces
    them to (driver, state, week) strata before the shuffle.
    """
    delivered = orders.where("is_delivered and is_in_kpi_window")
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("driver"),
                    dates.week_start(day).alias("week"),
                    F.expr(condition.format(far_km=params.far_km)).alias("exposed"),
                )
                for label, condition, day in DRIVERS
            ]
        )
    )
    observed = (
        delivered.select("customer_state", "is_late", "promised_days", "actual_days", rows.alias("_row"))
        .select("_row.*", "customer_state", "is_late", "promised_days", "actual_days")
        .where(F.col("exposed").isNotNull())
    )

    def side(exposed: Column, name: str) -> list[Column]:
        return [
            F.count_if(exposed).alias(f"{name}_orders"),
            count_where(exposed & F.col("is_late")).alias(f"{name}_late"),
            F.sum(F.when(exposed, F.col("promised_days"))).alias(f"{name}_promised"),
            F.sum(F.when(exposed, F.col("actual_days"))).alias(f"{name}_actual"),
        ]

    strata = observed.groupBy("driver", "customer_state", "week").agg(
        *side(F.col("exposed"), "with"), *side(~F.col("exposed"), "without")
    )
    comparable = (F.col("with_orders") > 0) & (F.col("without_orders") > 0)

    def gap(measure: str) -> Column:
        """Stratum difference of means, weighted by the exposed orders of the stratum."""
        difference = safe_ratio(f"with_{measure}", "with_orders") - safe_ratio(f"without_{measure}", "without_orders")
        return F.sum(F.when(comparable, F.col("with_orders") * difference))

    totals = strata.groupBy("driver").agg(
        *[F.sum(f"{s}_{m}").alias(f"{s}_{m}") for s in ("with", "without") for m in ("orders", "late")],
        F.sum(F.when(comparable, F.col("with_orders"))).alias("exposed_orders_compared"),
        *[gap(m).alias(f"_gap_{m}") for m in ("late", "actual", "promised")],
    )
    rate_with = safe_ratio("with_late", "with_orders")
    rate_without = safe_ratio("without_late", "without_orders")
    return totals.select(
        "driver",
        F.col("with_orders").alias("exposed_orders"),
        safe_ratio("with_orders", F.col("with_orders") + F.col("without_orders")).alias("share_exposed"),
        rate_with.alias("late_rate_exposed"),
        rate_without.alias("late_rate_not_exposed"),
        (rate_with - rate_without).alias("raw_late_rate_difference"),
        safe_ratio("_gap_late", "exposed_orders_compared").alias("adjusted_late_rate_difference"),
        safe_ratio("_gap_actual", "exposed_orders_compared").alias("adjusted_actual_days_difference"),
        safe_ratio("_gap_promised", "exposed_orders_compared").alias("adjusted_promised_days_difference"),
        "exposed_orders_compared",
        safe_ratio("exposed_orders_compared", "with_orders").alias("share_of_exposed_compared"),
    )


def live_daily(orders: DataFrame) -> DataFrame:
    """One row per purchase day of the synthetic feed. The windows count rows (days with orders)."""

    def outcome(label: str) -> Column:
        return count_where(F.col("delivery_outcome") == label)

    daily = (
        orders.where("is_synthetic")
        .groupBy("purchase_date")
        .agg(
            *_counts(),
            outcome(rules.OPEN).alias("open_orders"),
            outcome(rules.OVERDUE).alias("overdue_orders"),
            outcome(rules.CANCELLED).alias("cancelled_orders"),
            F.sum("gmv_eur").alias("gmv_eur"),
            F.sum("revenue_at_risk_eur").alias("revenue_at_risk_eur"),
            F.avg("review_score").alias("avg_review_score"),
            F.max("sim_as_of").alias("sim_as_of"),
        )
    )
    week, month = _trailing(7, "purchase_date"), _trailing(30, "purchase_date")
    return daily.withColumns(
        {
            "late_rate_so_far": safe_ratio("late_orders", "delivered_orders"),
            "orders_last_7_days": F.sum("orders").over(week),
            "late_rate_last_30_days": safe_ratio(
                F.sum("late_orders").over(month), F.sum("delivered_orders").over(month)
            ),
        }
    )
