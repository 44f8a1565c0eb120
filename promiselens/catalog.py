"""Every query by name: a function from a feed of model tables to a DataFrame."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promiselens.functions import dates
from promiselens.operators import asof, calendars, checks, series, sketches
from promiselens.plans import (
    declarations,
    drift,
    facts,
    findings,
    fit,
    marts,
    measures,
    profile,
    quality,
    staging,
    star,
    summaries,
    timeline,
    verify,
)
from promiselens.session import materialise, shared_folder
from promiselens.sources import fixed_values, landing, payloads, registry, sinks
from promiselens.sources.tables import TableFeed
from promiselens.streaming import deltas, history, snapshots

Query = Callable[[TableFeed], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(column: Column, digits: int) -> Column:
    """Half away from zero on the binary value, the arithmetic of the SQL side.

    Spark's own ``round`` works on the decimal text of a double, so the two differ on half a cent.
    """
    scale = F.lit(float(10**digits))
    return F.signum(column) * F.floor(F.abs(column) * scale + 0.5) / scale


def tidy(df: DataFrame, eur_digits: int = 2) -> DataFrame:
    """Comparable numbers: exact money with 4 digits, sums of converted money with 2, other doubles with 6."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = F.round(column.cast("double"), 4).alias(field.name)
        elif isinstance(field.dataType, T.DoubleType):
            converted = re.search(r"eur$|eur_", field.name) and field.name != "brl_per_eur"
            digits = eur_digits if converted else 4 if field.name.endswith("brl") else 6
            column = _rounded(column, digits).alias(field.name)
        columns.append(column)
    return df.select(*columns)


# ---- models


@query
def order_outcomes(feed: TableFeed) -> DataFrame:
    deadlines = summaries.items_summary(feed.items).select("order_id", "seller_ship_by_at")
    return tidy(timeline.order_timeline(feed.orders, deadlines, feed.params))


@query
def order_items_summary(feed: TableFeed) -> DataFrame:
    return tidy(summaries.items_summary(feed.items))


@query
def payment_summary(feed: TableFeed) -> DataFrame:
    return tidy(summaries.payments_summary(feed.payments))


@query
def latest_review(feed: TableFeed) -> DataFrame:
    return tidy(summaries.latest_reviews(feed.reviews))


@query
def fx_daily_fill(feed: TableFeed) -> DataFrame:
    return tidy(summaries.fx_daily(feed.fx_rates, feed.params))


@query
def state_holidays(feed: TableFeed) -> DataFrame:
    return summaries.state_holidays(feed.holidays, feed.states)


@query
def zip_centroids(feed: TableFeed) -> DataFrame:
    return tidy(summaries.zip_centroids(feed.geolocation))


@query
def haversine_routes(feed: TableFeed) -> DataFrame:
    """Distance of every order's route, summed up per route."""
    orders = facts.order_facts(feed, feed.params, ["route", "distance_km", "distance_band"])
    return tidy(
        orders.where("route is not null")
        .groupBy("route")
        .agg(
            F.count("distance_km").alias("orders_with_distance"),
            F.min("distance_km").alias("min_km"),
            F.avg("distance_km").alias("avg_km"),
            F.max("distance_km").alias("max_km"),
            F.count_if(F.col("distance_band") == "4: over 1,500 km").alias("orders_over_1500_km"),
        )
    )


@query
def order_context(feed: TableFeed) -> DataFrame:
    holidays = summaries.state_holidays(feed.holidays, feed.states)
    return tidy(timeline.order_context(feed.orders, feed.customers, holidays, feed.weather, feed.params))


@query
def fct_orders(feed: TableFeed) -> DataFrame:
    return tidy(facts.order_facts(feed, feed.params), eur_digits=8)


@query
def fct_orders_stored(feed: TableFeed) -> DataFrame:
    """The order fact from typed tables stored by order: they are grouped and joined without a shuffle."""
    return tidy(facts.order_facts(staging.store(feed, _folder(feed)), feed.params), eur_digits=8)


@query
def fct_order_items(feed: TableFeed) -> DataFrame:
    return tidy(facts.item_facts(feed, feed.params), eur_digits=8)


@query
def dim_date(feed: TableFeed) -> DataFrame:
    return tidy(facts.date_dimension(feed, feed.params))


@query
def dim_products(feed: TableFeed) -> DataFrame:
    return tidy(facts.product_dimension(feed, feed.params))


@query
def dim_sellers(feed: TableFeed) -> DataFrame:
    return tidy(facts.seller_dimension(feed, feed.params))


@query
def dim_states(feed: TableFeed) -> DataFrame:
    return feed.states


# ---- result tables


@query
def monthly_kpis(feed: TableFeed) -> DataFrame:
    return tidy(marts.monthly_kpis(facts.order_facts(feed, feed.params, marts.MONTHLY_NEEDS)))


@query
def route_performance(feed: TableFeed) -> DataFrame:
    return tidy(marts.route_performance(facts.order_facts(feed, feed.params, marts.ROUTE_NEEDS), feed.params))


@query
def seller_performance(feed: TableFeed) -> DataFrame:
    return tidy(marts.seller_performance(facts.item_facts(feed, feed.params), feed.params))


@query
def late_drivers(feed: TableFeed) -> DataFrame:
    return tidy(marts.late_drivers(facts.order_facts(feed, feed.params, marts.DRIVER_NEEDS), feed.params))


@query
def live_daily(feed: TableFeed) -> DataFrame:
    return tidy(marts.live_daily(facts.order_facts(feed, feed.params, marts.LIVE_NEEDS)))


# ---- findings


def _stored_orders(feed: TableFeed, needs: list[str]) -> DataFrame:
    """The asked fact columns, written once: for results that read them in several branches."""
    return materialise(facts.order_facts(feed, feed.params, needs))


def _order_query(name: str, function, needs: list[str]) -> None:
    QUERIES[name] = lambda feed: tidy(function(facts.order_facts(feed, feed.params, needs)))


for _function, _needs in [
    (findings.headline_kpis, findings.HEADLINE_NEEDS),
    (findings.risk_by_reason, findings.RISK_NEEDS),
    (findings.outcomes_value, findings.OUTCOME_NEEDS),
    (findings.review_by_outcome, findings.REVIEW_NEEDS),
    (findings.review_by_days_late, findings.REVIEW_NEEDS),
    (findings.stage_medians, findings.STAGE_NEEDS),
    (findings.approval_by_payment, findings.PAYMENT_NEEDS),
    (findings.late_causes, findings.CAUSE_NEEDS),
    (findings.region_summary, findings.REGION_NEEDS),
]:
    _order_query(_function.__name__, _function, _needs)


def _routes(feed: TableFeed) -> DataFrame:
    return marts.route_performance(facts.order_facts(feed, feed.params, marts.ROUTE_NEEDS), feed.params)


def _sellers(feed: TableFeed) -> DataFrame:
    return marts.seller_performance(facts.item_facts(feed, feed.params), feed.params)


@query
def ranked_drivers(feed: TableFeed) -> DataFrame:
    orders = facts.order_facts(feed, feed.params, marts.DRIVER_NEEDS)
    return tidy(findings.ranked_drivers(marts.late_drivers(orders, feed.params)))


@query
def top_routes(feed: TableFeed) -> DataFrame:
    return tidy(findings.ranked_routes(_routes(feed)))


@query
def worst_late_routes(feed: TableFeed) -> DataFrame:
    return tidy(findings.worst_late_routes(_routes(feed)))


@query
def route_head_share(feed: TableFeed) -> DataFrame:
    return tidy(findings.head_share(_routes(feed)))


@query
def seller_population(feed: TableFeed) -> DataFrame:
    return tidy(findings.seller_population(_sellers(feed)))


@query
def watchlist(feed: TableFeed) -> DataFrame:
    return tidy(findings.watchlist(_sellers(feed)))


@query
def top_risk_sellers(feed: TableFeed) -> DataFrame:
    return tidy(findings.top_risk_sellers(_sellers(feed)))


@query
def promise_backtest(feed: TableFeed) -> DataFrame:
    orders = _stored_orders(feed, findings.BACKTEST_NEEDS)
    return tidy(findings.promise_backtest(orders, feed.params))


# ---- semantic measures


@query
def semantic_measures(feed: TableFeed) -> DataFrame:
    needs = [*dict.fromkeys([*measures.NEEDS, *measures.SLICERS])]
    orders = facts.order_facts(feed, feed.params, needs).where("is_in_kpi_window")
    return tidy(measures.measure_by_slicers(orders, measures.SLICERS))


@query
def category_values(feed: TableFeed) -> DataFrame:
    return tidy(
        measures.category_values(facts.item_facts(feed, feed.params), facts.product_dimension(feed, feed.params))
    )


RATE_NEEDS = ["purchase_date", "is_in_kpi_window", "is_delivered", "is_late"]
_order_query("rolling_3m_calendar", measures.rolling_calendar_months, RATE_NEEDS)
_order_query("late_rate_vs_prior_month", measures.late_rate_vs_prior_month, RATE_NEEDS)
_order_query(
    "whatif_promise", measures.promise_what_if, ["is_in_kpi_window", "is_delivered", "actual_days", "promised_days"]
)


@query
def whatif_promise_by_region(feed: TableFeed) -> DataFrame:
    needs = ["is_in_kpi_window", "is_delivered", "actual_days", "promised_days", "customer_region"]
    return tidy(measures.promise_what_if(facts.order_facts(feed, feed.params, needs), "customer_region"))


# ---- data checks (each returns the violations)


@query
def dq_not_null(feed: TableFeed) -> DataFrame:
    return checks.not_null(feed.orders, "approved_at").select("order_id", "order_status", "purchased_at")


@query
def dq_unique(feed: TableFeed) -> DataFrame:
    return checks.unique(feed.items, "order_id")


@query
def dq_relationships(feed: TableFeed) -> DataFrame:
    return checks.relationship(feed.reviews, "order_id", feed.items, "order_id")


@query
def dq_accepted_values(feed: TableFeed) -> DataFrame:
    return checks.accepted_values(feed.payments, "payment_type", ["credit_card", "boleto"])


@query
def dq_accepted_range(feed: TableFeed) -> DataFrame:
    return checks.accepted_range(feed.geolocation, "latitude", -33.8, 5.3).select("zip_prefix", "latitude")


@query
def dq_unique_combination(feed: TableFeed) -> DataFrame:
    return checks.unique_combination(feed.items, "order_id", "order_item_number")


@query
def dq_expression(feed: TableFeed) -> DataFrame:
    violating = checks.expression_holds(feed.orders, quality.EVENTS_IN_ORDER, where="is_synthetic")
    return violating.select("order_id", "purchased_at", "approved_at", "shipped_at", "delivered_at")


@query
def dq_expression_strict(feed: TableFeed) -> DataFrame:
    violating = checks.expression_holds(feed.orders, "shipped_at <= sim_as_of", where="is_synthetic", strict=True)
    return violating.select("order_id", "shipped_at")


@query
def dq_equal_rowcount(feed: TableFeed) -> DataFrame:
    return checks.equal_rowcount(feed.items, feed.orders)


@query
def dq_value_reconciles_to_source(feed: TableFeed) -> DataFrame:
    return tidy(quality.value_differs_from_source(feed, feed.params))


@query
def dq_kpi_window_months(feed: TableFeed) -> DataFrame:
    orders = facts.order_facts(feed, feed.params, marts.MONTHLY_NEEDS)
    return quality.wrong_month_count(marts.monthly_kpis(orders), feed.params)


@query
def dq_monthly_matches_orders(feed: TableFeed) -> DataFrame:
    orders = _stored_orders(feed, marts.MONTHLY_NEEDS)
    return quality.monthly_differs_from_orders(marts.monthly_kpis(orders), orders)


@query
def dq_items_reconcile_to_orders(feed: TableFeed) -> DataFrame:
    needs = [*dict.fromkeys([*facts.ITEM_FACT_FROM_ORDER, "gmv_eur", "revenue_at_risk_eur"])]
    orders = _stored_orders(feed, needs)
    return tidy(quality.items_differ_from_orders(orders, facts.item_facts(feed, feed.params, orders)))


@query
def dq_model_report(feed: TableFeed) -> DataFrame:
    return quality.model_report(feed, feed.params)


@query
def dq_fact_report(feed: TableFeed) -> DataFrame:
    return quality.fact_report(feed, feed.params)


@query
def dq_mart_report(feed: TableFeed) -> DataFrame:
    orders = _stored_orders(feed, facts.ORDER_FACT_COLUMNS)
    items = materialise(facts.item_facts(feed, feed.params, orders))
    return quality.mart_report(feed, feed.params, orders, items)


@query
def dq_declared(feed: TableFeed) -> DataFrame:
    """All declared checks and reconciliations, each with its violations."""
    tables = declarations.checked_tables(feed, feed.params)
    return declarations.declared_report(tables, feed.params, declarations.source_values(feed))


@query
def dq_declared_broken(feed: TableFeed) -> DataFrame:
    """The same over tables that are broken on purpose: every check of every table has something to find."""
    tables = declarations.broken(declarations.checked_tables(feed, feed.params))
    return declarations.declared_report(tables, feed.params, declarations.source_values(feed))


# ---- profile


@query
def profile_table_rows(feed: TableFeed) -> DataFrame:
    names = ["orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events"]
    return profile.table_rows({name: feed.table(name) for name in names}, {"events"})


@query
def profile_status(feed: TableFeed) -> DataFrame:
    return profile.status_counts(feed.orders)


@query
def profile_months(feed: TableFeed) -> DataFrame:
    return profile.orders_per_month(feed.orders)


@query
def profile_impossible_timestamps(feed: TableFeed) -> DataFrame:
    return profile.impossible_timestamps(feed.orders)


@query
def profile_lateness_basis(feed: TableFeed) -> DataFrame:
    return profile.lateness_by_date_or_time(feed.orders)


@query
def profile_reviews(feed: TableFeed) -> DataFrame:
    return profile.review_multiplicity(feed.orders, feed.reviews)


@query
def profile_payment_types(feed: TableFeed) -> DataFrame:
    return tidy(profile.payments_by_type(feed.payments))


@query
def profile_payments_match(feed: TableFeed) -> DataFrame:
    return profile.payments_match_items(feed.items, feed.payments)


@query
def profile_customers(feed: TableFeed) -> DataFrame:
    return profile.customers_and_people(feed.customers)


@query
def profile_deadline_anchor(feed: TableFeed) -> DataFrame:
    return tidy(profile.deadline_anchor(feed.orders, feed.items, feed.params))


@query
def profile_multi_seller(feed: TableFeed) -> DataFrame:
    return profile.multi_seller_orders(feed.items)


@query
def profile_products(feed: TableFeed) -> DataFrame:
    return profile.product_categories(feed.products, feed.categories)


@query
def profile_geolocation(feed: TableFeed) -> DataFrame:
    return profile.geolocation_outliers(feed.geolocation)


@query
def profile_series(feed: TableFeed) -> DataFrame:
    return profile.series_extents(
        {
            "holidays": (feed.holidays, "holiday_date"),
            "weather": (feed.weather, "weather_date"),
            "rates": (feed.fx_rates, "rate_date"),
        }
    )


# ---- second path


def _compared(feed: TableFeed, second_path: DataFrame) -> DataFrame:
    orders = facts.order_facts(feed, feed.params, verify.FACT_NEEDS)
    compared = verify.compare_metrics(second_path, verify.from_facts(orders))
    is_rate = F.col("metric") == verify.RATE_METRIC

    def shown(name: str) -> Column:
        value = F.col(name)
        return F.when(is_rate, _rounded(value, 6)).otherwise(_rounded(value, 2)).alias(name)

    return compared.select(
        "metric", shown("expected"), shown("actual"), F.round("difference", 4).alias("difference"), "match"
    )


@query
def recompute_headline(feed: TableFeed) -> DataFrame:
    return _compared(feed, verify.recomputed(feed, feed.params))


@query
def recompute_from_text(feed: TableFeed) -> DataFrame:
    """The headline numbers straight from landed text against those of the facts."""
    root = _folder(feed)
    for name in ("orders", "items", "reviews", "fx_rates"):
        landing.LAND[name](feed, root)
    return _compared(feed, verify.recomputed_from_text(feed.spark, root, feed.params))


# ---- fitted distributions


def _fit_query(name: str, function, needs: list[str]) -> None:
    QUERIES[name] = lambda feed: tidy(function(facts.order_facts(feed, feed.params, needs), feed.params))


_fit_query("volume_weekdays", fit.weekday_means, fit.HISTORY_NEEDS)
_fit_query("volume_months", fit.month_factors, fit.HISTORY_NEEDS)
_fit_query("event_uplift", fit.event_uplift, fit.HISTORY_NEEDS)
_fit_query("peak_factor", fit.peak_factor, fit.PEAK_NEEDS)
_order_query("hour_shares", fit.hour_shares, fit.HISTORY_NEEDS)
_order_query("outcome_shares", fit.outcome_shares, fit.OUTCOME_NEEDS)
_order_query("no_review_share", fit.no_review_share, fit.REVIEW_NEEDS)
_order_query("score_shares", fit.score_shares, fit.REVIEW_NEEDS)
_order_query("sent_day_shares", fit.sent_day_shares, fit.REVIEW_NEEDS)
_order_query("review_grids", fit.review_grids, fit.REVIEW_NEEDS)


def _approval_query(name: str, function) -> None:
    def run(feed: TableFeed) -> DataFrame:
        orders = facts.order_facts(feed, feed.params, fit.APPROVAL_NEEDS)
        return tidy(function(orders, fit.bank_calendar(feed, feed.params), feed.params))

    QUERIES[name] = run


_approval_query("approval_lag_shares", fit.approval_lag_shares)
_approval_query("approval_hour_shares", fit.approval_hour_shares)
_approval_query("approval_minutes", fit.approval_minutes)


@query
def journey_templates(feed: TableFeed) -> DataFrame:
    return tidy(fit.journey_templates(feed, feed.params))


@query
def template_items(feed: TableFeed) -> DataFrame:
    lines = feed.items.drop("shipping_limit_at")
    return tidy(fit.template_lines(fit.journey_templates(feed, feed.params), lines, feed.params))


@query
def template_payments(feed: TableFeed) -> DataFrame:
    return tidy(fit.template_lines(fit.journey_templates(feed, feed.params), feed.payments, feed.params))


@query
def price_index(feed: TableFeed) -> DataFrame:
    return tidy(fit.price_index(feed.inflation))


def _price_factors(feed: TableFeed) -> DataFrame:
    months = feed.orders.select(dates.month_start(F.col("purchased_at").cast("date")).alias("month_start")).distinct()
    return fit.price_factors(feed.inflation, months, feed.params.kpi_start, feed.params)


@query
def price_factors(feed: TableFeed) -> DataFrame:
    return tidy(_price_factors(feed))


@query
def value_at_purchase(feed: TableFeed) -> DataFrame:
    """The last event value known when an order was bought; events come many times a day and share no key with the orders."""
    events = feed.table("events").select(F.expr("ts - interval 24 years").alias("known_at"), "event_id", F.col("value").alias("known_value"))
    orders = feed.orders.select("order_id", "purchased_at")
    return tidy(asof.as_of_join(orders, events, "purchased_at", "known_at", ["event_id", "known_value"], "event_id"))


@query
def filled_event_values(feed: TableFeed) -> DataFrame:
    """Event values by time with the gaps filled: every third event has no value of its own."""
    own = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    series = feed.table("events").groupBy("ts").agg(F.max_by(F.struct(own.alias("v")), "event_id").getField("v").alias("value"))
    return tidy(asof.forward_filled(series, "ts", "value"))


@query
def payment_rescale(feed: TableFeed) -> DataFrame:
    totals = summaries.items_summary(feed.items).select("order_id", F.col("gmv_brl").alias("new_total"))
    return tidy(fit.rescaled_payments(feed.payments, totals, feed.params))


# ---- calendars


@query
def bank_days(feed: TableFeed) -> DataFrame:
    return fit.bank_calendar(feed, feed.params)


@query
def bank_days_between(feed: TableFeed) -> DataFrame:
    orders = feed.orders.select("order_id", "purchased_at", "promised_date")
    calendar = fit.bank_calendar(feed, feed.params)
    return calendars.with_bank_days_between(orders, "purchased_at", "promised_date", calendar, "bank_days")


@query
def bank_days_added(feed: TableFeed) -> DataFrame:
    orders = feed.orders.select("order_id", "purchased_at")
    lag = (F.col("order_id") % 5).cast("int")
    calendar = fit.bank_calendar(feed, feed.params)
    return calendars.with_bank_days_added(orders, "purchased_at", lag, calendar, "clearing_day")


# ---- live feed


@query
def as_of_snapshot(feed: TableFeed) -> DataFrame:
    return snapshots.orders_as_of(feed.planned_orders, feed.params.snapshot_after)


@query
def snapshot_diff(feed: TableFeed) -> DataFrame:
    before, after = feed.params.snapshot_before, feed.params.snapshot_after
    return snapshots.snapshot_diff(
        snapshots.orders_as_of(feed.planned_orders, before),
        snapshots.orders_as_of(feed.planned_orders, after),
        snapshots.reviews_as_of(feed.reviews, before),
        snapshots.reviews_as_of(feed.reviews, after),
    )


def _as_of_query(name: str) -> None:
    """What the shop knows of a table at both moments, from its stored history."""

    def as_of(feed: TableFeed) -> DataFrame:
        root, params = _folder(feed), feed.params
        rows = history.stored_form(history.histories(feed, params)[name])
        sinks.commit(feed.spark, root, {name: sinks.write_version(rows, f"{root}/{name}", "until_month")})
        stored = sinks.read_table(feed.spark, root, name)
        views = [history.as_of(stored, moment) for moment in (params.snapshot_before, params.snapshot_after)]
        return tidy(views[0].unionByName(views[1]))

    QUERIES[f"as_of_{name}"] = as_of


for _name in ("orders", "items", "payments", "reviews", "customers"):
    _as_of_query(_name)


@query
def stored_snapshot_diff(feed: TableFeed) -> DataFrame:
    """The same line as ``snapshot_diff`` from two stored snapshots, of which only unequal buckets are read again."""
    spark, root, params = feed.spark, _folder(feed), feed.params
    moments = {"before": params.snapshot_before, "after": params.snapshot_after}
    for name, moment in moments.items():
        orders = snapshots.orders_as_of(feed.planned_orders, moment)
        deltas.store_snapshot(orders, f"{root}/orders/{name}", "order_id", F.date_format("purchased_at", "yyyy-MM"), 1)
        reviews = snapshots.reviews_as_of(feed.reviews, moment)
        deltas.store_snapshot(reviews, f"{root}/reviews/{name}", "review_id", F.date_format("review_answered_at", "yyyy-MM"), 1)
    found = deltas.order_changes(spark, f"{root}/orders/before", f"{root}/orders/after")
    now, then = [F.lit(m.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") for m in (moments["after"], moments["before"])]
    counted = [
        F.coalesce(sinks.read_table(spark, f"{root}/reviews/{name}", "sums").agg(F.sum("rows")).scalar(), F.lit(0)) for name in moments
    ]
    return found.withColumns(
        {
            "sim_as_of": now,
            "previous_sim_as_of": then,
            "days_covered": F.datediff(now.cast("date"), then.cast("date")),
            "reviews_total": counted[1],
            "new_reviews": counted[1] - counted[0],
        }
    )


@query
def share_vectors(feed: TableFeed) -> DataFrame:
    return tidy(drift.share_vectors(facts.order_facts(feed, feed.params, drift.NEEDS), feed.params))


@query
def drift_report(feed: TableFeed) -> DataFrame:
    return tidy(drift.drift_report(_stored_orders(feed, drift.NEEDS), _price_factors(feed), feed.params))


# ---- landing reshapes and series checks


@query
def array_to_rows(feed: TableFeed) -> DataFrame:
    rows = payloads.daily_arrays_to_rows(feed.weather_payload)
    return tidy(series.without_trailing_blanks(rows, "time", "precipitation_sum", "state_code"))


@query
def incomplete_days(feed: TableFeed) -> DataFrame:
    payload = feed.weather_payload.select("state_code", "daily.*")
    start, end = feed.params.calendar_start, feed.params.calendar_end
    bad = series.incomplete_days(payload, "time", start, end, ["precipitation_sum"])
    return bad.select("state_code", F.size("time").alias("days"))


@query
def map_to_rows(feed: TableFeed) -> DataFrame:
    return tidy(payloads.rate_map_to_rows(feed.rate_payload))


@query
def monthly_text(feed: TableFeed) -> DataFrame:
    return tidy(payloads.monthly_text_to_rows(feed.inflation_text))


@query
def coded_months(feed: TableFeed) -> DataFrame:
    return tidy(payloads.coded_months_to_rows(feed.inflation_coded))


@query
def series_gaps(feed: TableFeed) -> DataFrame:
    return series.gaps(feed.holidays, "holiday_date", 5)


@query
def series_gaps_by_state(feed: TableFeed) -> DataFrame:
    return series.gaps(feed.weather, "weather_date", 5, "state_code")


@query
def series_missing_months(feed: TableFeed) -> DataFrame:
    return series.missing_months(feed.inflation.where("pct_change > 0"), "month_start")


@query
def series_implausible(feed: TableFeed) -> DataFrame:
    return tidy(series.implausible(feed.fx_rates, "brl_per_eur", 3.3, 3.9))


@query
def series_coverage(feed: TableFeed) -> DataFrame:
    return series.uncovered(feed.fx_rates, "rate_date", feed.params.calendar_start, feed.params.calendar_end)


@query
def series_staleness(feed: TableFeed) -> DataFrame:
    return series.stale(feed.inflation, "month_start", feed.params.calendar_end)


@query
def wrong_partition(feed: TableFeed) -> DataFrame:
    fields = feed.holidays.select("holiday_date", "holiday_name")
    return series.wrong_partition(fields, "holiday_date", feed.params.event_year, holiday_name="1-URGENT")


@query
def feed_log(feed: TableFeed) -> DataFrame:
    return payloads.feed_log(feed.holidays, state_level=F.col("state_iso_codes").isNotNull())


@query
def source_priority(feed: TableFeed) -> DataFrame:
    """The primary source lacks months and the backup holds implausible values, so the saved one is used."""
    today, full = feed.params.data_cutoff, feed.inflation
    sources = {
        "primary": full.where("pct_change > 0"),
        "backup": full.withColumn("pct_change", F.col("pct_change") * 10),
        "saved": full,
    }
    violations = {
        name: [
            series.implausible(df, "pct_change", -3.0, 5.0),
            series.missing_months(df, "month_start"),
            series.stale(df, "month_start", today),
        ]
        for name, df in sources.items()
    }
    violations["saved"] = violations["saved"][2:]
    return tidy(series.first_valid_source(sources, violations))


# ---- files: written to the shared folder and read back


def _folder(feed: TableFeed) -> str:
    return f"{shared_folder(feed.spark)}/promiselens/{uuid.uuid4().hex}"


def _raw_orders(feed: TableFeed) -> DataFrame:
    """The orders as a landed text table, labels included."""
    typed = ["order_id", "customer_id", "order_status", "purchased_at", "approved_at", "shipped_at", "delivered_at"]
    names = registry.ORDERS.split()
    return feed.orders.select(
        *[F.col(old).alias(new) for old, new in zip(typed, names)],
        F.col("promised_date").cast("timestamp_ntz").alias(names[-1]),
        "data_source",
        "is_synthetic",
        "sim_as_of",
    )


@query
def csv_round_trip(feed: TableFeed) -> DataFrame:
    """Text snapshot -> raw text table -> typed orders."""
    root = _folder(feed)
    sinks.write_csv_text(_raw_orders(feed), f"{root}/sim/sim_orders.csv")
    return staging.orders(registry.load_raw(feed.spark, root, "sim_orders"), feed.params)


@query
def json_round_trip(feed: TableFeed) -> DataFrame:
    """NDJSON with lineage -> typed holidays, arrays kept."""
    root = _folder(feed)
    public, bank = F.array(F.lit("Public")), F.array(F.lit("Bank"))
    types = F.concat(
        F.when(F.col("is_public_holiday"), public).otherwise(F.array().cast("array<string>")),
        F.when(F.col("is_bank_holiday"), bank).otherwise(F.array().cast("array<string>")),
    )
    records = feed.holidays.select(
        F.col("holiday_date").cast("string").alias("date"),
        F.col("holiday_name").alias("localName"),
        F.col("holiday_name").alias("name"),
        F.lit("BR").alias("countryCode"),
        F.col("is_nationwide").alias("global"),
        F.col("state_iso_codes").alias("counties"),
        types.alias("types"),
    )
    landed = sinks.with_lineage(records, "tables/orders", "2001-12-31T00:00:00+00:00")
    sinks.write_ndjson(landed, f"{root}/holidays/holidays_BR_all.ndjson")
    typed = staging.holidays(registry.load_raw(feed.spark, root, "holidays")).drop("holiday_name_local")
    return typed.withColumn("state_iso_codes", F.array_join("state_iso_codes", " "))


@query
def parquet_export(feed: TableFeed) -> DataFrame:
    """Exact decimals leave as doubles; the fact is partitioned by month for pruning."""
    root = _folder(feed)
    needs = ["order_id", "purchase_date", "gmv_brl", "delivery_outcome"]
    orders = facts.order_facts(feed, feed.params, needs).withColumn("month", dates.month_start("purchase_date"))
    sinks.export_parquet({"fct_orders": orders}, root, {"fct_orders": "month"})
    return tidy(sinks.read_table(feed.spark, root, "fct_orders"))


@query
def file_manifest(feed: TableFeed) -> DataFrame:
    """Files, bytes, digests and parsed records of a landed table, summed up."""
    root = _folder(feed)
    sinks.write_csv_text(_raw_orders(feed), f"{root}/sim/sim_orders.csv")
    found = registry.manifest(feed.spark, root, registry.RAW_TABLES["sim_orders"]).where(F.col("file").endswith(".csv"))
    return found.agg(
        (F.count(F.lit(1)) > 0).alias("has_files"),
        (F.min(F.length("sha256")) == 64).alias("has_digests"),
        F.sum("rows").alias("records"),
    )


@query
def star_generation(feed: TableFeed) -> DataFrame:
    """Rows and value of every table of the star, read by generation after a later refresh stopped before its commit."""
    root = f"{_folder(feed)}/star"
    star.build(feed, feed.params, root)
    unfinished = sinks.read_table(feed.spark, root, "fct_orders").where("is_late")
    for name in ("fct_orders", "mart_monthly_kpis"):
        sinks.write_version(unfinished, f"{root}/{name}")
    lines = []
    for name, df in star.current(feed.spark, root).items():
        value = next((c for c in ("item_gmv_eur", "gmv_eur") if c in df.columns), None)
        total = F.sum(value) if value else F.lit(None).cast("double")
        lines.append(df.agg(F.count(F.lit(1)).alias("rows"), total.alias("value_eur")).select(F.lit(name).alias("table"), "rows", "value_eur"))
    return tidy(reduce(DataFrame.unionByName, lines), eur_digits=1)


# ---- staging: a table landed as text, both feeds, and typed again


def _staged(name: str) -> Query:
    def staged(feed: TableFeed) -> DataFrame:
        root = _folder(feed)
        landing.LAND[name](feed, root)
        return tidy(getattr(staging.LandedFeed(feed.spark, root, feed.params), name))

    return staged


for _name in landing.LAND:
    QUERIES[f"staged_{_name}"] = _staged(_name)


@query
def staged_labels(feed: TableFeed) -> DataFrame:
    """Provenance of the items of both feeds, as staging reads it from the files."""
    root = _folder(feed)
    landing.land_items(feed, root)
    names = ["order_items", "sim_order_items"]
    both = [staging.items(registry.load_raw(feed.spark, root, name), feed.params) for name in names]
    return both[0].unionByName(both[1]).groupBy("data_source", "is_synthetic", "sim_as_of").agg(
        F.count(F.lit(1)).alias("items")
    )


@query
def landed_files(feed: TableFeed) -> DataFrame:
    """Rows in the landed files of the two review feeds; no other table is landed here, and no missing file is looked for."""
    root = _folder(feed)
    landing.land_reviews(feed, root)
    feeds = ["order_reviews", "sim_order_reviews"]
    counted = registry.row_counts({name: registry.load_raw(feed.spark, root, name) for name in feeds})
    return counted.select("table", "rows")


def _landed(feed: TableFeed) -> str:
    """All tables landed as text by a finished run; the folder of that run."""
    root = _folder(feed)
    landing.land_all(feed, root)
    return landing.current(feed.spark, root)


@query
def landed_rejects(feed: TableFeed) -> DataFrame:
    """Records, loaded and rejected ones of every landed table, with as many broken records landed beside the good ones."""
    root = _landed(feed)
    for name in landing.LANDED:
        landing.spoil(feed.spark, root, name)
    checked = {name: registry.load_checked(feed.spark, root, name) for name in landing.LANDED}
    per_file = reduce(DataFrame.unionByName, [registry.landing_report(df, name) for name, df in checked.items()])
    kept = reduce(DataFrame.unionByName, [registry.rejects(df, name) for name, df in checked.items()])
    held = kept.groupBy("table").agg(F.count("record").alias("kept_rejects"))
    sums = [F.sum(c).alias(c) for c in ("records", "loaded", "rejected")]
    return per_file.groupBy("table").agg(*sums).join(held, "table", "left")


@query
def missing_tables(feed: TableFeed) -> DataFrame:
    """Raw tables without a landed file."""
    return registry.missing_tables(feed.spark, _landed(feed)).select("table")


@query
def sketched_percentiles(feed: TableFeed) -> DataFrame:
    """Delivery days by region, route and month from sketches of (route, month) cells, and whether their rank error is kept.

    The answer of a sketch is right within an error e if at most p + e of the rows lie below it, and p - e or more at it or below.
    """
    levels = {"region": ["customer_region"], "route": ["route"], "month": ["month"], "all": []}
    needs = ["route", "customer_region", "purchase_date", "actual_days"]
    orders = facts.order_facts(feed, feed.params, needs).withColumn("month", dates.year_month("purchase_date"))
    known = materialise(orders.where(F.col("actual_days").isNotNull()).na.fill("none", ["route"]))
    cells = materialise(sketches.sketched(known, ["customer_region", "route", "month"], "actual_days"))
    error, lines = 2 * sketches.rank_error(), []
    for level, by in levels.items():
        rolled = sketches.rolled_up(cells, by)
        answers = rolled.select(
            *by, sketches.rows_of().alias("orders"),
            *[sketches.percentile_of(p).alias(f"_q{n}") for n, p in enumerate((0.5, 0.9))],
        )
        # One row a cell of the level, so the answers are few beside the orders.
        joined = known.join(answers, by) if by else known.withColumns({c: answers.select(c).scalar() for c in answers.columns})
        inside = []
        for n, p in enumerate((0.5, 0.9)):
            below = F.avg((F.col("actual_days") < F.col(f"_q{n}")).cast("double"))
            upto = F.avg((F.col("actual_days") <= F.col(f"_q{n}")).cast("double"))
            inside.append(((below <= p + error) & (upto >= p - error)).alias(f"p{round(100 * p)}_within"))
        name = F.col(by[0]) if by else F.lit("all")
        grouped = joined.groupBy(name.alias("cell")).agg(F.max("orders").alias("orders"), F.count(F.lit(1)).alias("exact_orders"), *inside)
        lines.append(grouped.select(F.lit(level).alias("level"), "cell", "orders", "exact_orders", "p50_within", "p90_within"))
    return reduce(DataFrame.unionByName, lines)


@query
def seed_states(feed: TableFeed) -> DataFrame:
    """The customers of each state's region by the landed state code; the seed holds no state of these tables."""
    seeds = fixed_values.states(feed.spark)
    held = feed.customers.groupBy(F.col("customer_state").alias("state_code")).agg(F.count(F.lit(1)).alias("customers"))
    return held.join(F.broadcast(seeds.select("state_code", F.lit(True).alias("seeded"))), "state_code", "left").select(
        "state_code", "customers", F.coalesce("seeded", F.lit(False)).alias("is_seeded")
    )


# ---- checks of the whole model and of landed records


@query
def dq_fact_rowcount(feed: TableFeed) -> DataFrame:
    """The order fact has a row for every order of both feeds; a row here means it has not."""
    return checks.equal_rowcount(facts.order_facts(feed, feed.params, ["order_id"]), feed.orders)


@query
def missing_values(feed: TableFeed) -> DataFrame:
    """Landed reviews without an answer time or a sending date."""
    found = series.missing_values(feed.reviews, ["review_answered_at", "review_sent_date"])
    return found.select("review_id", "order_id")


@query
def weather_of_states(feed: TableFeed) -> DataFrame:
    """Weather of the states asked for only."""
    asked = series.of_keys(feed.weather, "state_code", ["nation_2", "NATION_17", "nowhere"])
    return asked.groupBy("state_code").agg(F.count(F.lit(1)).alias("days"))


@query
def holiday_years(feed: TableFeed) -> DataFrame:
    """Records of the years a holiday list is needed for."""
    params = feed.params
    years = payloads.required_years(params.kpi_start.year, params.kpi_end.year, params.last_calendar_day.year)
    year = F.year("holiday_date").alias("year")
    return feed.holidays.groupBy(year).agg(F.count(F.lit(1)).alias("records")).where(F.col("year").isin(years))


@query
def month_keys(feed: TableFeed) -> DataFrame:
    """Orders per month key, and the key two months before."""
    day = F.col("purchased_at").cast("date")
    keys = feed.orders.select(dates.month_key(day).alias("month"), dates.month_key(day, 2).alias("two_before"))
    return keys.groupBy("month", "two_before").agg(F.count(F.lit(1)).alias("orders"))
