"""Distributions learned from the historical feed, journey templates, price index, payment re-scaling.

Every result is a small table; orders are first counted per day, hour, lag or bucket with map-side
combine, and everything after that works on bounded counts.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.functions import dates, rules, text
from promiselens.functions.order import nulls_last
from promiselens.functions.stats import PERCENTILE_GRID, count_where, percentile_grid, safe_ratio
from promiselens.operators.calendars import bank_day_index, bank_holidays_of, calendar_days, with_bank_days_between
from promiselens.operators.joins import lookup_join, renamed
from promiselens.operators.ranking import add_dense_id
from promiselens.params import Params
from promiselens.plans import summaries
from promiselens.session import materialise

HISTORY_NEEDS = ["purchase_date", "purchased_at", "is_in_kpi_window"]
APPROVAL_NEEDS = ["is_in_kpi_window", "purchased_at", "approved_at", "approval_hours", "main_payment_type"]
PEAK_NEEDS = ["is_in_kpi_window", "is_delivered", "has_timestamp_anomaly", "transit_days", "shipped_date",
              "purchase_date"]
OUTCOME_NEEDS = ["is_in_kpi_window", "order_status", "delivery_outcome"]
REVIEW_NEEDS = ["is_in_kpi_window", "delivery_outcome", "days_late", "review_score", "delivered_date", "promised_date",
                "review_sent_date", "review_answered_at"]


def share_table(df: DataFrame, *keys: str, within: list[str] | None = None) -> DataFrame:
    """Counts per key as shares of their total (or of the total of each ``within`` group)."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*(within or [])))  # over counts, not rows
    return counted.withColumn("share", safe_ratio("count", total))


def grid_rows(df: DataFrame, value: Column, *keys: str, out: str = "value") -> DataFrame:
    """(keys, percentile, value) at the fixed grid; groups without a value give no rows."""
    learned = df.withColumn("_value", value).where(F.col("_value").isNotNull())
    points = F.array(*[F.lit(float(p)) for p in PERCENTILE_GRID])
    return (
        learned.groupBy(*keys)
        .agg(percentile_grid("_value").alias("_grid"))
        .where(F.col("_grid").isNotNull())
        .select(*keys, F.inline(F.arrays_zip(points.alias("percentile"), F.col("_grid").alias(out))))
    )


def _normal_month(params: Params, day: str = "purchase_date") -> Column:
    return ~dates.year_month(day).isin(list(params.excluded_months))


# ---- volume


def _daily(orders: DataFrame) -> DataFrame:
    """Orders per day. Several branches read it, so the (calendar-sized) table is written once."""
    return materialise(
        orders.where("is_in_kpi_window")
        .groupBy("purchase_date")
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumns({"weekday": dates.iso_weekday("purchase_date"), "month": F.month("purchase_date")})
    )


def _event_window(params: Params) -> tuple[Column, Column]:
    first = dates.black_friday(F.lit(params.event_year))
    return first, F.date_add(first, params.event_days - 1)


def _level(daily: DataFrame, params: Params) -> DataFrame:
    return daily.where(F.col("purchase_date").between(F.lit(params.level_start), F.lit(params.level_end)))


def _event_year_means(daily: DataFrame, params: Params) -> DataFrame:
    """Mean orders per day by month of the event year, the event week left out."""
    first, last = _event_window(params)
    usual = daily.where((F.year("purchase_date") == params.event_year) & ~F.col("purchase_date").between(first, last))
    return usual.groupBy("month").agg(F.avg("orders").alias("per_day"))


def _weekday_means(daily: DataFrame, params: Params) -> DataFrame:
    return _level(daily, params).groupBy("weekday").agg(F.avg("orders").alias("mean_orders"))


def weekday_means(orders: DataFrame, params: Params) -> DataFrame:
    return _weekday_means(_daily(orders), params)


def month_factors(orders: DataFrame, params: Params) -> DataFrame:
    """Size of each month relative to the mean of the level months. Months after the level period are
    chained on: the last level month times the event year's ratio to that month."""
    daily = _daily(orders)
    last = params.level_end.month
    level = _level(daily, params).groupBy("month").agg(F.avg("orders").alias("per_day"))
    mean = level.agg(F.avg("per_day")).scalar()
    in_level = level.select("month", (F.col("per_day") / mean).alias("factor"))
    event_year = _event_year_means(daily, params)
    anchor = event_year.where(F.col("month") == last).agg(F.max("per_day")).scalar()
    anchor_factor = in_level.where(F.col("month") == last).agg(F.max("factor")).scalar()
    chained = event_year.where(F.col("month") > last).select(
        "month", (anchor_factor * F.col("per_day") / anchor).alias("factor")
    )
    return in_level.unionByName(chained)


def event_uplift(orders: DataFrame, params: Params) -> DataFrame:
    """Orders of each event day relative to a normal November day of the same weekday."""
    daily = _daily(orders)
    first, last = _event_window(params)
    weekdays = _weekday_means(daily, params)
    mean = weekdays.agg(F.avg("mean_orders")).scalar()
    november = _event_year_means(daily, params).where("month = 11").agg(F.max("per_day")).scalar()
    expected = november * F.col("mean_orders") / mean
    return (
        daily.where(F.col("purchase_date").between(first, last))
        .join(weekdays, "weekday")
        .select(
            F.datediff("purchase_date", first).alias("day_offset"),
            "orders",
            (F.col("orders") / expected).alias("uplift"),
        )
    )


def hour_shares(orders: DataFrame) -> DataFrame:
    """All 24 hours, also those without an order."""
    counted = orders.where("is_in_kpi_window").groupBy(F.hour("purchased_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("count")
    )
    hours = orders.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    total = F.sum("count").over(Window.partitionBy())  # over the 24 hours
    return hours.join(counted, "hour", "left").select(
        "hour", safe_ratio(F.coalesce("count", F.lit(0)), total).alias("share")
    )


# ---- approval


def _approvals(orders: DataFrame) -> DataFrame:
    return orders.where(
        "is_in_kpi_window and approved_at is not null and approval_hours >= 0 and main_payment_type is not null"
    )


def bank_calendar(feed, params: Params) -> DataFrame:
    """Bank days of all days that an order names, and of the reporting calendar, with a margin on either side.

    The first and last day are looked up in the orders (one row), so no order lies outside; the margin keeps
    "n bank days later" inside.
    """
    named = ["purchased_at", "approved_at", "shipped_at", "delivered_at", "promised_date"]
    days = [F.col(c).cast("date") for c in named]
    first, last = feed.orders.agg(F.min(F.least(*days)), F.max(F.greatest(*days))).first()
    start = min(params.calendar_start, first or params.calendar_start)
    end = max(params.last_calendar_day, last or params.last_calendar_day)
    margin = timedelta(days=params.calendar_margin_days)
    return bank_day_index(calendar_days(feed.spark, start, end + margin), bank_holidays_of(feed.holidays))


def approval_lags(orders: DataFrame, calendar: DataFrame, params: Params) -> DataFrame:
    """Approved orders with ``lag`` = bank days from purchase to approval, capped."""
    lagged = with_bank_days_between(_approvals(orders), "purchased_at", "approved_at", calendar, "lag")
    return lagged.withColumn("lag", F.least("lag", F.lit(params.max_approval_lag)))


def approval_lag_shares(orders: DataFrame, calendar: DataFrame, params: Params) -> DataFrame:
    boleto = approval_lags(orders, calendar, params).where("main_payment_type = 'boleto'")
    return share_table(boleto.select("lag"), "lag")


def approval_hour_shares(orders: DataFrame, calendar: DataFrame, params: Params) -> DataFrame:
    later = approval_lags(orders, calendar, params).where("main_payment_type = 'boleto' and lag >= 1")
    return share_table(later.select(F.hour("approved_at").alias("hour")), "hour")


def approval_minutes(orders: DataFrame, calendar: DataFrame, params: Params) -> DataFrame:
    """Minutes to approval by payment type; for bank slips only those approved on the same day."""
    shown = approval_lags(orders, calendar, params).where("main_payment_type <> 'boleto' or lag = 0")
    typed = shown.withColumnRenamed("main_payment_type", "payment_type")
    return grid_rows(typed, F.col("approval_hours") * 60, "payment_type", out="minutes")


# ---- season, outcomes, reviews


def peak_factor(orders: DataFrame, params: Params) -> DataFrame:
    """How much slower carriers are in the peak season: ratio of two medians from one pass."""
    year = params.event_year
    moved = orders.where("is_in_kpi_window and is_delivered and not has_timestamp_anomaly and transit_days >= 0")
    in_peak = (F.year("shipped_date") == year) & dates.in_season("shipped_date", params.peak_start, params.peak_end)
    medians = moved.agg(
        F.median(F.when(in_peak, F.col("transit_days"))).alias("peak_days"),
        F.median(F.when(_normal_month(params), F.col("transit_days"))).alias("normal_days"),
    )
    return medians.withColumn("transit_factor", safe_ratio("peak_days", "normal_days"))


def outcome_shares(orders: DataFrame) -> DataFrame:
    status, overdue = F.col("order_status"), F.col("delivery_outcome") == rules.OVERDUE
    outcome = (
        F.when(status.isin(rules.CLOSED_WITHOUT_DELIVERY), status)
        .when(overdue & (status == "shipped"), "lost_in_transit")
        .when(overdue, "stuck_before_shipping")
        .otherwise("delivered")
    )
    return share_table(orders.where("is_in_kpi_window").select(outcome.alias("outcome")), "outcome")


def _reviewed(orders: DataFrame) -> DataFrame:
    judged = orders.where(F.col("is_in_kpi_window") & (F.col("delivery_outcome") != rules.DATE_MISSING))
    return judged.select(
        rules.review_bucket().alias("bucket"),
        "review_score",
        "delivery_outcome",
        dates.days_between("delivered_date", "review_sent_date").alias("after_delivery"),
        dates.days_between("promised_date", "review_sent_date").alias("after_promise"),
        (dates.minutes_between(F.col("review_sent_date").cast("timestamp_ntz"), "review_answered_at") / 60.0).alias(
            "answer_hours"
        ),
    )


def no_review_share(orders: DataFrame) -> DataFrame:
    return _reviewed(orders).agg(
        F.count(F.lit(1)).alias("orders"),
        safe_ratio(count_where(F.col("review_score").isNull()), F.count(F.lit(1))).alias("no_review_share"),
    )


def score_shares(orders: DataFrame) -> DataFrame:
    scored = _reviewed(orders).where("review_score is not null and bucket is not null")
    return share_table(scored, "bucket", "review_score", within=["bucket"])


def sent_day_shares(orders: DataFrame, low: int = -2, high: int = 7) -> DataFrame:
    on_time = _reviewed(orders).where("review_score is not null and bucket = 'on_time'")
    day = F.least(F.greatest(F.col("after_delivery"), F.lit(low)), F.lit(high))
    return share_table(on_time.select(day.alias("days_after_delivery")), "days_after_delivery")


def review_grids(orders: DataFrame) -> DataFrame:
    """Days from promise to sending by kind of broken promise, and hours from sending to answer."""
    reviewed = _reviewed(orders).where("review_score is not null")
    kind = (
        F.when(F.col("delivery_outcome") == rules.LATE, "late")
        .when(F.col("bucket") == "never_delivered", "never_delivered")
        .when(F.col("bucket") == "cancelled", "cancelled")
    )
    lines = F.array(
        F.struct(kind.alias("kind"), F.col("after_promise").cast("double").alias("value")),
        F.struct(F.lit("answer_hours").alias("kind"), F.greatest(F.col("answer_hours"), F.lit(0.0)).alias("value")),
    )
    long = reviewed.select(F.inline(lines)).where("kind is not null")
    return grid_rows(long, F.col("value"), "kind")


# ---- journey templates


def journey_templates(feed, params: Params) -> DataFrame:
    """Clean delivered orders of normal months with their stage lengths, numbered in order of id."""
    purchased = F.col("purchased_at").cast("date")
    orders = feed.orders.where(
        (F.col("data_source") == params.historical_source)
        & (F.col("order_status") == "delivered")
        & purchased.between(F.lit(params.kpi_start), F.lit(params.kpi_end))
        & _normal_month(params, "purchased_at")
        & (F.col("approved_at") >= F.col("purchased_at"))
        & (F.col("shipped_at") >= F.col("approved_at"))
        & (F.col("delivered_at") >= F.col("shipped_at"))
    )
    summary = summaries.items_summary(feed.items).select("order_id", "seller_ship_by_at", "primary_seller_id")
    paid = feed.payments.select("order_id").distinct()
    clean = (
        orders.join(summary, "order_id")
        .where(F.col("seller_ship_by_at") > F.col("approved_at"))
        .join(paid, "order_id", "left_semi")
    )

    def days(start: str, end: str) -> Column:
        return dates.seconds_between(start, end) / F.lit(86400.0)

    placed = lookup_join(
        clean, feed.customers.drop("customer_unique_id"), ["customer_id"], params, "inner", feed.orders, ["order_id"]
    )
    sellers = feed.sellers.select(F.col("seller_id").alias("primary_seller_id"), "seller_state")
    sold = renamed(summaries.item_keys(feed), primary_seller_id="seller_id", order_id="order_id")
    placed = lookup_join(placed, sellers, ["primary_seller_id"], params, "inner", sold, ["order_id"])
    templates = placed.select(
        F.col("order_id").alias("source_order_id"),
        dates.year_month("purchased_at").alias("purchase_month"),
        "customer_zip_prefix",
        "customer_city",
        "customer_state",
        "primary_seller_id",
        "seller_state",
        text.route_label("seller_state", "customer_state").alias("route"),
        dates.days_between(purchased, "promised_date").alias("promised_days"),
        days("approved_at", "seller_ship_by_at").alias("deadline_days"),
        days("approved_at", "shipped_at").alias("handover_days"),
        days("shipped_at", "delivered_at").alias("transit_days"),
    )
    return add_dense_id(templates, ["source_order_id"], "template_id")


def template_lines(templates: DataFrame, lines: DataFrame, params: Params) -> DataFrame:
    """The items or payments of the templates, one row each (an order's lines are never collected)."""
    ids = templates.select(F.col("source_order_id").alias("order_id"), "template_id")
    spread = [c for c in lines.columns if c != "order_id"]
    return lookup_join(lines, ids, ["order_id"], params, "inner", lines, spread).drop("order_id")


# ---- prices


def price_index(inflation: DataFrame) -> DataFrame:
    """Price level by month, the running product of monthly changes (a monthly series is small)."""
    months = Window.orderBy("month_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return inflation.select(
        "month_start", F.product(1 + F.col("pct_change") / 100).over(months).alias("price_index")
    )


def price_factors(inflation: DataFrame, months: DataFrame, base_month, params: Params) -> DataFrame:
    """What an order of ``month_start`` costs relative to ``base_month``, using only the index known then.

    The index is completed to every month by carrying the last known month forward, so "latest month
    not after the reference month" becomes an equi-join.
    """
    index = price_index(inflation)
    span = index.agg(F.min("month_start").alias("_first"), F.max("month_start").alias("_last"))
    wanted = months.agg(F.max("month_start")).scalar()
    every = span.select(
        F.explode(F.sequence("_first", F.greatest("_last", wanted), F.expr("interval 1 month"))).alias("month_start")
    )
    carried = Window.orderBy("month_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = every.join(index, "month_start", "left").select(
        F.add_months("month_start", params.price_lag_months).alias("month_start"),
        F.last("price_index", ignorenulls=True).over(carried).alias("known_index"),
    )
    base = index.where(F.col("month_start") == F.lit(base_month)).agg(F.max("price_index")).scalar()
    return months.join(known, "month_start", "left").withColumn("price_factor", F.col("known_index") / base)


def rescaled_payments(payments: DataFrame, new_totals: DataFrame, params: Params) -> DataFrame:
    """Each order's payments scaled to its new total, to the cent; the rest goes to one largest payment.

    Equal payments are counted first, so "one of them" is the first copy. Order sums and the largest payment are
    aggregates with map-side combine, not windows, so an order with very many payments does not meet in one task.
    The scaled payments are written once, as both the sums and the result read them.
    """
    cents = "decimal(28,2)"
    kinds = ["payment_sequence", "payment_type", "installments", "payment_brl"]
    equal = payments.groupBy("order_id", *kinds).agg(F.count(F.lit(1)).alias("_copies"))
    totals = payments.groupBy("order_id").agg(F.sum("payment_brl").alias("_old"))
    per_order = totals.join(new_totals.select("order_id", F.col("new_total").cast(cents).alias("_new")), "order_id")
    spread = ["payment_sequence", "payment_brl"]
    ratio = F.col("payment_brl").cast("double") * F.col("_new").cast("double")
    old = F.when(F.col("_old") == 0, 1.0).otherwise(F.col("_old").cast("double"))
    scaled = materialise(
        lookup_join(equal, per_order, ["order_id"], params, "inner", payments, spread)
        .withColumn("_scaled", F.round(ratio / old, 2).cast(cents))
        .select("order_id", *kinds, "_copies", "_new", "_scaled")
    )
    place = F.struct(*kinds)
    order = nulls_last(-F.col("_scaled"), "payment_sequence", "payment_brl", "payment_type", "installments")
    rest = scaled.groupBy("order_id").agg(
        (F.max("_new") - F.sum(F.col("_scaled") * F.col("_copies"))).cast(cents).alias("_rest"),
        F.min_by(place, order).alias("_largest"),
    )
    joined = lookup_join(scaled, rest, ["order_id"], params, "inner", payments, spread)
    copy = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    corrected = place.eqNullSafe(F.col("_largest")) & (F.col("_copy") == 1)
    return copy.select(
        "order_id",
        "payment_sequence",
        "payment_type",
        "installments",
        (F.col("_scaled") + F.when(corrected, F.col("_rest")).otherwise(F.lit(0).cast(cents))).cast(cents).alias("scaled_brl"),
    )
