"""Finding tables: headline numbers, breakdowns, top lists and the promise back-test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.functions import rules
from promiselens.functions.stats import avg_where, continuous_percentile, count_where, safe_ratio, share_where
from promiselens.params import Params

HEADLINE_NEEDS = ["is_in_kpi_window", "is_delivered", "is_late", "delivery_outcome", "gmv_eur", "late_gmv_eur",
                  "revenue_at_risk_eur", "promised_days", "actual_days"]
RISK_NEEDS = ["is_in_kpi_window", "revenue_at_risk_reason", "revenue_at_risk_eur"]
OUTCOME_NEEDS = ["is_in_kpi_window", "delivery_outcome", "gmv_eur"]
REVIEW_NEEDS = ["is_in_kpi_window", "is_delivered", "delivery_outcome", "days_late", "review_score", "is_low_review"]
STAGE_NEEDS = ["is_in_kpi_window", "is_delivered", "is_late", "approval_hours", "handover_days", "transit_days",
               "promised_days"]
PAYMENT_NEEDS = ["is_in_kpi_window", "is_delivered", "is_late", "approval_hours", "main_payment_type"]
CAUSE_NEEDS = ["is_in_kpi_window", "is_late", "late_cause", "late_gmv_eur"]
REGION_NEEDS = ["is_in_kpi_window", "is_delivered", "is_late", "customer_region", "promised_days", "actual_days",
                "revenue_at_risk_eur"]
BACKTEST_NEEDS = ["is_delivered", "data_source", "route", "customer_state", "purchase_date", "promised_days",
                  "actual_days", "is_late"]


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def headline_kpis(orders: DataFrame) -> DataFrame:
    delivered, late = F.col("is_delivered"), F.col("is_late")
    return orders.where("is_in_kpi_window").agg(
        _rows("orders"),
        count_where(delivered).alias("delivered_orders"),
        count_where(late).alias("late_orders"),
        safe_ratio(count_where(late), count_where(delivered)).alias("late_rate"),
        count_where(F.col("delivery_outcome") == rules.OVERDUE).alias("overdue_orders"),
        *[F.sum(name).alias(name) for name in ("gmv_eur", "late_gmv_eur", "revenue_at_risk_eur")],
        avg_where(delivered, "promised_days").alias("avg_promised_days"),
        F.avg("actual_days").alias("avg_actual_days"),
    )


def risk_by_reason(orders: DataFrame) -> DataFrame:
    at_risk = orders.where("is_in_kpi_window and revenue_at_risk_reason is not null")
    return (
        at_risk.groupBy(F.col("revenue_at_risk_reason").alias("reason"))
        .agg(_rows("orders"), F.sum("revenue_at_risk_eur").alias("revenue_at_risk_eur"))
        .orderBy(F.col("revenue_at_risk_eur").desc())
    )


def outcomes_value(orders: DataFrame) -> DataFrame:
    return (
        orders.where("is_in_kpi_window")
        .groupBy("delivery_outcome")
        .agg(_rows("orders"), F.sum("gmv_eur").alias("gmv_eur"))
        .orderBy(F.col("orders").desc())
    )


def review_by_outcome(orders: DataFrame) -> DataFrame:
    shown = F.col("delivery_outcome").isin(rules.ON_TIME, rules.LATE, rules.OVERDUE)
    return (
        orders.where(F.col("is_in_kpi_window") & shown & F.col("review_score").isNotNull())
        .groupBy("delivery_outcome")
        .agg(
            F.count("review_score").alias("reviewed_orders"),
            F.avg("review_score").alias("avg_review"),
            share_where(F.col("is_low_review")).alias("share_low_review"),
        )
        .orderBy(F.col("reviewed_orders").desc())
    )


def review_by_days_late(orders: DataFrame) -> DataFrame:
    return (
        orders.where("is_delivered and is_in_kpi_window and review_score is not null")
        .groupBy(rules.days_late_band().alias("days_late_band"))
        .agg(
            _rows("orders"),
            F.avg("review_score").alias("avg_review"),
            share_where(F.col("is_low_review")).alias("share_low_review"),
        )
        .orderBy("days_late_band")
    )


def stage_medians(orders: DataFrame) -> DataFrame:
    """Exact medians: stage times have minute resolution, so a group's distinct values are bounded."""
    return (
        orders.where("is_delivered and is_in_kpi_window")
        .groupBy(F.when(F.col("is_late"), rules.LATE).otherwise(rules.ON_TIME).alias("outcome"))
        .agg(
            F.median("approval_hours").alias("median_approval_hours"),
            F.median("handover_days").alias("median_seller_days"),
            F.median("transit_days").alias("median_carrier_days"),
            F.avg("promised_days").alias("avg_promised_days"),
        )
        .orderBy(F.col("outcome").desc())
    )


def approval_by_payment(orders: DataFrame) -> DataFrame:
    return (
        orders.where("is_delivered and is_in_kpi_window and main_payment_type <> 'not_defined'")
        .groupBy(F.col("main_payment_type").alias("payment_type"))
        .agg(
            _rows("delivered_orders"),
            F.median("approval_hours").alias("median_approval_hours"),
            continuous_percentile("approval_hours", 0.9).alias("p90_approval_hours"),
            share_where(F.col("is_late")).alias("late_rate"),
        )
        .orderBy(F.col("delivered_orders").desc())
    )


def late_causes(orders: DataFrame) -> DataFrame:
    causes = (
        orders.where("is_late and is_in_kpi_window")
        .groupBy("late_cause")
        .agg(_rows("late_orders"), F.sum("late_gmv_eur").alias("late_gmv_eur"))
    )
    all_late = F.sum("late_orders").over(Window.partitionBy())  # over the handful of causes
    return causes.select(
        "late_cause", "late_orders", safe_ratio("late_orders", all_late).alias("share"), "late_gmv_eur"
    ).orderBy(F.col("late_orders").desc())


def ranked_drivers(drivers: DataFrame) -> DataFrame:
    return drivers.orderBy(F.col("adjusted_late_rate_difference").desc_nulls_last())


def ranked_routes(routes: DataFrame) -> DataFrame:
    return routes.where("is_rankable").orderBy("revenue_at_risk_rank", "route")


def worst_late_routes(routes: DataFrame, top: int = 10) -> DataFrame:
    return (
        routes.where("is_rankable")
        .orderBy(F.col("late_rate").desc(), "route")
        .limit(top)
        .select(
            "route", "delivered_orders", "late_rate", "avg_promised_days", "avg_actual_days", "p90_actual_days",
            "avg_distance_km",
        )
    )


def head_share(routes: DataFrame, top: int = 10) -> DataFrame:
    """Share of the revenue at risk held by the first routes of the ranking."""
    head = routes.where("is_rankable").orderBy("revenue_at_risk_rank", "route").limit(top)
    return head.agg(_rows("routes"), F.sum("share_of_revenue_at_risk").alias("share_of_revenue_at_risk"))


def region_summary(orders: DataFrame) -> DataFrame:
    return (
        orders.where("is_delivered and is_in_kpi_window")
        .groupBy("customer_region")
        .agg(
            _rows("delivered_orders"),
            share_where(F.col("is_late")).alias("late_rate"),
            F.avg("promised_days").alias("avg_promised_days"),
            F.avg("actual_days").alias("avg_actual_days"),
            F.sum("revenue_at_risk_eur").alias("revenue_at_risk_eur"),
        )
        .orderBy(F.col("late_rate").desc())
    )


def seller_population(sellers: DataFrame) -> DataFrame:
    watched = F.col("is_on_watchlist")

    def watched_share(value: str) -> Column:
        return safe_ratio(F.sum(F.when(watched, F.col(value)).otherwise(0.0)), F.sum(value))

    return sellers.agg(
        _rows("sellers"),
        count_where(F.col("is_rankable")).alias("sellers_with_enough_orders"),
        count_where(watched).alias("watchlist_sellers"),
        F.max("platform_late_rate").alias("platform_late_rate"),
        watched_share("gmv_eur").alias("watchlist_share_of_gmv"),
        watched_share("revenue_at_risk_eur").alias("watchlist_share_of_revenue_at_risk"),
    )


SELLER_SHOWN = ["seller", "state", "delivered_orders", "late_rate", "missed_ship_by_rate", "avg_review_score"]


def _short_seller(sellers: DataFrame) -> DataFrame:
    return sellers.withColumn("seller", F.substring(F.col("seller_id").cast("string"), 1, 8)).withColumn(
        "state", F.col("seller_state")
    )


def watchlist(sellers: DataFrame, top: int = 10) -> DataFrame:
    return (
        _short_seller(sellers.where("is_on_watchlist"))
        .orderBy(F.col("revenue_at_risk_eur").desc(), "seller_id")
        .limit(top)
        .select(*SELLER_SHOWN, "gmv_eur", "revenue_at_risk_eur")
    )


def top_risk_sellers(sellers: DataFrame, top: int = 10) -> DataFrame:
    return (
        _short_seller(sellers.where("is_rankable"))
        .orderBy("revenue_at_risk_rank", "seller_id")
        .limit(top)
        .select(
            F.col("revenue_at_risk_rank").alias("rank"), *SELLER_SHOWN, "revenue_at_risk_eur",
            F.col("is_on_watchlist").alias("watchlist"),
        )
    )


def promise_backtest(orders: DataFrame, params: Params) -> DataFrame:
    """What would have happened had each route promised its own past percentile?

    All percentiles are learned in one pass per level. The test orders are first counted per
    (route, state, promised, actual) - a few thousand combinations however many orders a route has -
    and only those counts meet the learned tables.
    """
    usable = orders.where(
        F.col("is_delivered") & F.col("route").isNotNull() & (F.col("data_source") == params.historical_source)
    )
    train = usable.where(F.col("purchase_date").between(F.lit(params.train_start), F.lit(params.train_end)))
    test = usable.where(F.col("purchase_date").between(F.lit(params.test_start), F.lit(params.test_end)))
    levels = list(params.backtest_percentiles)
    learned = F.percentile("actual_days", levels)
    by_route = (
        train.groupBy("route")
        .agg(_rows("_n"), learned.alias("_route_days"))
        .where(F.col("_n") >= params.min_train_orders)
        .drop("_n")
    )
    by_state = train.groupBy("customer_state").agg(learned.alias("_state_days"))
    overall = train.agg(learned.alias("_all_days")).scalar()
    counted = test.groupBy("route", "customer_state", "promised_days", "actual_days", "is_late").agg(_rows("_n"))
    proposals = F.coalesce("_route_days", "_state_days", "_all_days")
    scored = (
        counted.join(by_route, "route", "left")
        .join(by_state, "customer_state", "left")
        .withColumn("_all_days", overall)
        .select("*", F.posexplode(proposals).alias("_level", "_days"))
        .withColumn("percentile", F.element_at(F.array(*[F.lit(p) for p in levels]), F.col("_level") + 1))
        # Interpolation noise (26.000000000000004) must not lengthen a promise by a day.
        .withColumn("proposed_days", F.ceil(F.round("_days", 9)))
    )
    total = F.sum("_n")

    def mean(value: Column) -> Column:
        return safe_ratio(F.sum(value * F.col("_n")), total)

    return (
        scored.groupBy("percentile")
        .agg(
            total.alias("orders"),
            mean(F.col("promised_days")).alias("current_avg_promise_days"),
            mean(F.col("is_late").cast("int")).alias("current_late_rate"),
            mean(F.col("proposed_days")).alias("proposed_avg_promise_days"),
            mean((F.col("actual_days") > F.col("proposed_days")).cast("int")).alias("proposed_late_rate"),
        )
        .orderBy("percentile")
    )
