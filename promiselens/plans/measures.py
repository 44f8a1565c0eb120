"""Semantic measures: named aggregate expressions that work under any grouping of the order fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.functions import dates, rules
from promiselens.functions.stats import count_where, safe_ratio

NEEDS = ["purchase_date", "is_in_kpi_window", "is_delivered", "is_late", "delivery_outcome", "late_cause", "gmv_eur",
         "late_gmv_eur", "revenue_at_risk_eur", "promised_days", "actual_days", "review_score",
         "is_low_review"]
SLICERS = ["customer_region", "main_payment_type", "delivery_outcome", "distance_band"]


def components() -> dict[str, Column]:
    """Additive parts of the measures: they can be summed over any further grouping."""
    delivered, late = F.col("is_delivered"), F.col("is_late")
    return {
        "orders": F.count(F.lit(1)),
        "delivered_orders": count_where(delivered),
        "late_orders": count_where(late),
        "overdue_orders": count_where(F.col("delivery_outcome") == rules.OVERDUE),
        "gmv_eur": F.sum("gmv_eur"),
        "late_gmv_eur": F.sum("late_gmv_eur"),
        "revenue_at_risk_eur": F.sum("revenue_at_risk_eur"),
        "_promised_sum": F.sum(F.when(delivered, F.col("promised_days"))),
        "_promised_n": F.count(F.when(delivered, F.col("promised_days"))),
        "_actual_sum": F.sum("actual_days"),
        "_actual_n": F.count("actual_days"),
        "_score_sum": F.sum("review_score"),
        "_score_n": F.count("review_score"),
        "_low_n": count_where(F.col("is_low_review")),
        "_seller_late_n": count_where(late & (F.col("late_cause") == rules.CAUSE_SELLER)),
    }


def measures() -> dict[str, Column]:
    """The named measures over aggregated components."""
    late_rate = safe_ratio("late_orders", "delivered_orders")
    promised, actual = safe_ratio("_promised_sum", "_promised_n"), safe_ratio("_actual_sum", "_actual_n")
    plain = ["orders", "delivered_orders", "late_orders", "overdue_orders", "gmv_eur", "late_gmv_eur",
             "revenue_at_risk_eur"]
    return {
        **{name: F.col(name) for name in plain},
        "late_rate": late_rate,
        "on_time_rate": 1 - late_rate,
        "revenue_at_risk_share": safe_ratio("revenue_at_risk_eur", "gmv_eur"),
        "avg_promised_days": promised,
        "avg_actual_days": actual,
        "promise_buffer_days": promised - actual,
        "avg_review": safe_ratio("_score_sum", "_score_n"),
        "low_review_share": safe_ratio("_low_n", "_score_n"),
        "seller_caused_share_of_late": safe_ratio("_seller_late_n", "late_orders"),
    }


def measure_by(orders: DataFrame, *by: str, names: list[str] | None = None) -> DataFrame:
    """The measures (all, or the named ones) under a grouping of the fact."""
    parts = orders.groupBy(*by).agg(*[column.alias(name) for name, column in components().items()])
    chosen = measures()
    return parts.select(*by, *[chosen[name].alias(name) for name in (names or chosen)])


def measure_by_slicers(orders: DataFrame, slicers: list[str]) -> DataFrame:
    """The measures under every slicer, from one pass over the fact.

    The fact is aggregated to the combinations of the slicers (a few hundred); those are rolled up.
    """
    parts = components()
    cells = orders.groupBy(*slicers).agg(*[column.alias(name) for name, column in parts.items()])
    pairs = F.array(*[F.struct(F.lit(s).alias("slicer"), F.col(s).cast("string").alias("value")) for s in slicers])
    rolled = (
        cells.select("*", F.inline(pairs))
        .groupBy("slicer", "value")
        .agg(*[F.sum(name).alias(name) for name in parts])
    )
    chosen = measures()
    return rolled.select("slicer", "value", *[column.alias(name) for name, column in chosen.items()])


def category_values(items: DataFrame, products: DataFrame) -> DataFrame:
    """Item value by product category. Items are summed per product first, so a best-seller is one row."""
    values = ["item_gmv_eur", "late_gmv_eur", "revenue_at_risk_eur"]
    per_product = items.where("is_in_kpi_window").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("items"), *[F.sum(v).alias(v) for v in values]
    )
    named = per_product.join(products.select("product_id", "category_name_en"), "product_id")
    return named.groupBy("category_name_en").agg(F.sum("items").alias("items"), *[F.sum(v).alias(v) for v in values])


def _daily(orders: DataFrame) -> DataFrame:
    return orders.where("is_in_kpi_window").groupBy("purchase_date").agg(
        count_where(F.col("is_late")).alias("late"), count_where(F.col("is_delivered")).alias("delivered")
    )


def rolling_calendar_months(orders: DataFrame, months: int = 3) -> DataFrame:
    """Late rate over the trailing calendar months of each day (days, not rows, are counted back).

    The fact shrinks to one row per day; each day is then handed to the days whose period holds it.
    """
    longest = 31 * months
    reached = F.explode(F.sequence(F.col("purchase_date"), F.date_add("purchase_date", longest)))
    last = F.max("purchase_date").over(Window.partitionBy())  # over the days
    return (
        _daily(orders)
        .withColumn("_last", last)
        .withColumn("date_day", reached)
        .where((F.add_months("date_day", -months) < F.col("purchase_date")) & (F.col("date_day") <= F.col("_last")))
        .groupBy("date_day")
        .agg(
            F.sum("late").alias("late_orders"),
            F.sum("delivered").alias("delivered_orders"),
            safe_ratio(F.sum("late"), F.sum("delivered")).alias("late_rate_3m"),
        )
    )


def late_rate_vs_prior_month(orders: DataFrame) -> DataFrame:
    """Compared with the calendar month before; a missing month gives an empty comparison."""
    monthly = (
        _daily(orders)
        .groupBy(dates.month_start("purchase_date").alias("month_start"))
        .agg(safe_ratio(F.sum("late"), F.sum("delivered")).alias("late_rate"))
    )
    ordered = Window.orderBy("month_start")  # over the months
    follows = F.lag("month_start").over(ordered) == F.add_months("month_start", -1)
    return monthly.withColumn("prior_late_rate", F.when(follows, F.lag("late_rate").over(ordered))).withColumn(
        "late_rate_change", F.col("late_rate") - F.col("prior_late_rate")
    )


def promise_what_if(orders: DataFrame, *by: str, extra_days: tuple[int, int] = (-7, 7)) -> DataFrame:
    """Late rate had every promise been ``extra`` days longer, for each extra of the range."""
    slack = F.col("actual_days") - F.col("promised_days")
    counted = (
        orders.where("is_in_kpi_window and is_delivered")
        .groupBy(*by, slack.alias("_slack"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    extras = F.explode(F.sequence(F.lit(extra_days[0]), F.lit(extra_days[1])))
    late = F.sum(F.when(F.col("_slack") > F.col("extra_days"), F.col("_n")).otherwise(0))
    return (
        counted.withColumn("extra_days", extras)
        .groupBy(*by, "extra_days")
        .agg(F.sum("_n").alias("delivered_orders"), safe_ratio(late, F.sum("_n")).alias("simulated_late_rate"))
    )
