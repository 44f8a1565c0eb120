"""Delivery rules on hand-made orders."""

from datetime import date, datetime

import pytest

from promiselens.params import Params
from promiselens.plans import summaries, timeline

ORDERS = (
    "order_id string, customer_id string, order_status string, purchased_at timestamp_ntz, approved_at timestamp_ntz, "
    "shipped_at timestamp_ntz, delivered_at timestamp_ntz, promised_date date, data_source string, is_synthetic boolean, "
    "sim_as_of timestamp_ntz"
)
PURCHASED = datetime(2018, 1, 1, 10)


def order(name, status, shipped, delivered, promised, purchased=PURCHASED, as_of=None):
    return (name, "c", status, purchased, purchased, shipped, delivered, promised, "marketplace", False, as_of)


CASES = [
    (order("on_promised_day", "delivered", datetime(2018, 1, 3, 9), datetime(2018, 1, 10, 18, 30), date(2018, 1, 10)),
     ("On time", False, 0, None, 9, 9)),
    (order("one_day_late", "delivered", datetime(2018, 1, 3, 9), datetime(2018, 1, 11, 8), date(2018, 1, 10)),
     ("Late", True, 1, "After hand-over (carrier or promise)", 9, 10)),
    (order("seller_shipped_late", "delivered", datetime(2018, 1, 8, 9), datetime(2018, 1, 13, 12), date(2018, 1, 10)),
     ("Late", True, 3, "Seller shipped late", 9, 12)),
    (order("lost_in_transit", "shipped", datetime(2018, 1, 3, 9), None, date(2018, 1, 20)),
     ("Overdue, not delivered", None, 0, None, 19, None)),
    (order("not_due_yet", "shipped", datetime(2018, 10, 12, 9), None, date(2018, 11, 5), datetime(2018, 10, 10, 10)),
     ("Open, not yet due", None, 0, None, 26, None)),
    (order("cancelled", "canceled", None, None, date(2018, 1, 20)), ("Cancelled", None, 0, None, 19, None)),
    (order("no_date", "delivered", datetime(2018, 1, 3, 9), None, date(2018, 1, 20)),
     ("Delivered, date missing", None, 0, None, 19, None)),
    (order("impossible", "delivered", datetime(2017, 12, 3, 9), datetime(2018, 1, 13, 12), date(2018, 1, 10)),
     ("Late", True, 3, "Unclear (timestamp issue)", 9, 12)),
]


@pytest.fixture(scope="module")
def judged(spark):
    orders = spark.createDataFrame([row for row, _ in CASES], ORDERS)
    deadlines = spark.createDataFrame(
        [(row[0], datetime(2018, 1, 5, 23, 59, 59)) for row, _ in CASES], "order_id string, seller_ship_by_at timestamp_ntz"
    )
    return {r.order_id: r for r in timeline.order_timeline(orders, deadlines, Params()).collect()}


@pytest.mark.parametrize("row, expected", CASES, ids=[row[0] for row, _ in CASES])
def test_outcome(judged, row, expected):
    r = judged[row[0]]
    assert (r.delivery_outcome, r.is_late, r.days_late, r.late_cause, r.promised_days, r.actual_days) == expected


def test_masked_stage_times(judged):
    assert judged["impossible"].has_timestamp_anomaly
    assert judged["impossible"].handover_days is None and judged["impossible"].transit_days is None
    assert judged["impossible"].approval_hours == 0
    assert judged["one_day_late"].handover_days == pytest.approx(47 / 24)
    assert judged["cancelled"].seller_missed_ship_by is None


def test_overdue_is_judged_at_snapshot_time(spark):
    as_of = datetime(2026, 10, 10, 2)
    rows = [
        order("open", "shipped", None, None, date(2026, 10, 15), datetime(2026, 9, 20, 10), as_of),
        order("overdue", "shipped", None, None, date(2026, 10, 1), datetime(2026, 9, 20, 10), as_of),
    ]
    deadlines = spark.createDataFrame([], "order_id string, seller_ship_by_at timestamp_ntz")
    found = timeline.order_timeline(spark.createDataFrame(rows, ORDERS), deadlines, Params()).collect()
    assert {r.order_id: r.delivery_outcome for r in found} == {
        "open": "Open, not yet due", "overdue": "Overdue, not delivered",
    }


def test_rate_is_carried_over_the_weekend(spark):
    rates = spark.createDataFrame([(date(2017, 1, 6), 3.40), (date(2017, 1, 9), 3.45)], "rate_date date, brl_per_eur double")
    params = Params(calendar_start=date(2017, 1, 5), calendar_end=date(2017, 1, 9))
    days = summaries.fx_daily(rates, params).orderBy("rate_date").collect()
    assert [r.brl_per_eur for r in days] == [None, 3.40, 3.40, 3.40, 3.45]
    assert [r.is_published_rate for r in days] == [False, True, False, False, True]


def test_later_answer_wins(spark):
    rows = [
        ("r_old", "o1", 1, False, date(2018, 1, 11), datetime(2018, 1, 11, 9)),
        ("r_new", "o1", 4, True, date(2018, 1, 16), datetime(2018, 1, 16, 9)),
        ("r_only", "o2", 5, False, date(2018, 1, 11), datetime(2018, 1, 11, 9)),
        ("r_b", "o3", 2, False, date(2018, 1, 11), datetime(2018, 1, 11, 9)),
        ("r_a", "o3", 3, False, date(2018, 1, 11), datetime(2018, 1, 11, 9)),
    ]
    schema = (
        "review_id string, order_id string, review_score int, has_comment boolean, review_sent_date date, "
        "review_answered_at timestamp_ntz"
    )
    latest = {r.order_id: r for r in summaries.latest_reviews(spark.createDataFrame(rows, schema)).collect()}
    assert (latest["o1"].review_id, latest["o1"].review_score, latest["o1"].reviews_for_order) == ("r_new", 4, 2)
    assert (latest["o2"].review_score, latest["o2"].reviews_for_order) == (5, 1)
    assert latest["o3"].review_id == "r_a"


def test_primary_seller_and_main_payment_ties(spark):
    from decimal import Decimal

    items = spark.createDataFrame(
        [("o", "b", Decimal(5), Decimal(1), PURCHASED), ("o", "a", Decimal(3), Decimal(1), PURCHASED),
         ("o", "a", Decimal(2), Decimal(1), datetime(2018, 2, 1))],
        "order_id string, seller_id string, price_brl decimal(28,6), freight_brl decimal(28,6), shipping_limit_at timestamp_ntz",
    )
    row = summaries.items_summary(items).first()
    assert (row.primary_seller_id, row.item_count, row.seller_count, row.gmv_brl) == ("a", 3, 2, Decimal(13))
    assert row.seller_ship_by_at == datetime(2018, 2, 1)
    payments = spark.createDataFrame(
        [("o", 2, "voucher", 1, Decimal(5)), ("o", 1, "boleto", 3, Decimal(5))],
        "order_id string, payment_sequence int, payment_type string, installments int, payment_brl decimal(28,6)",
    )
    row = summaries.payments_summary(payments).first()
    assert (row.main_payment_type, row.max_installments, row.used_voucher) == ("boleto", 3, True)


def test_state_holidays_merge_names(spark):
    holidays = spark.createDataFrame(
        [(date(2018, 1, 1), "B", True, None, True, False), (date(2018, 1, 1), "A", False, ["BR-SP", "BR-XX"], False, True)],
        "holiday_date date, holiday_name string, is_nationwide boolean, state_iso_codes array<string>, "
        "is_public_holiday boolean, is_bank_holiday boolean",
    )
    states = spark.createDataFrame([("SP", "SE"), ("RJ", "SE")], "state_code string, region string")
    found = {r.state_code: r for r in summaries.state_holidays(holidays, states).collect()}
    assert set(found) == {"SP", "RJ"}
    assert found["SP"].holiday_names == "A / B" and found["SP"].is_bank_holiday and found["SP"].is_weekday
    assert found["RJ"].holiday_names == "B" and not found["RJ"].is_bank_holiday


def test_exposure_windows(spark):
    orders = spark.createDataFrame(
        [("in", "SP", date(2018, 1, 1), date(2018, 1, 2)), ("edge", "SP", date(2018, 1, 2), None),
         ("none", "RJ", date(2018, 1, 1), date(2018, 1, 2))],
        "order_id string, customer_state string, purchase_date date, shipped_date date",
    )
    holidays = spark.createDataFrame(
        [("SP", date(2018, 1, 10), True), ("SP", date(2018, 1, 11), True), ("SP", date(2018, 1, 5), False)],
        "state_code string, holiday_date date, is_weekday boolean",
    )
    weather = spark.createDataFrame(
        [("SP", date(2018, 1, 2), 20.0), ("SP", date(2018, 1, 8), 5.0), ("SP", date(2018, 1, 9), 99.0)],
        "state_code string, weather_date date, precipitation_mm double",
    )
    found = {r.order_id: r for r in timeline.add_context(orders, holidays, weather, Params()).collect()}
    assert found["in"].weekday_holidays_first_10_days == 1  # day 9 counts, day 10 does not
    assert found["edge"].weekday_holidays_first_10_days == 2
    assert (found["in"].heavy_rain_days_first_7_days_transit, found["in"].rain_mm_first_7_days_transit) == (1, 25.0)
    assert found["edge"].heavy_rain_days_first_7_days_transit is None
    assert (found["none"].heavy_rain_days_first_7_days_transit, found["none"].rain_mm_first_7_days_transit) == (0, None)


def test_late_driver_adjustment_by_hand(spark):
    """Two strata: one with both groups (difference 0.5), one with exposed orders only (not compared)."""
    from promiselens.plans import marts

    columns = (
        "customer_state string, seller_state string, purchase_date date, shipped_date date, is_in_kpi_window boolean, "
        "is_delivered boolean, is_late boolean, promised_days int, actual_days int, seller_missed_ship_by boolean, "
        "main_payment_type string, weekday_holidays_first_10_days int, heavy_rain_days_first_7_days_transit int, "
        "distance_km double"
    )

    def row(day, late, missed, actual):
        return ("SP", "SP", day, day, True, True, late, 10, actual, missed, "boleto", 0, 0, None)

    monday, next_week = date(2018, 1, 1), date(2018, 1, 8)
    rows = [row(monday, True, True, 14), row(monday, False, True, 8), row(monday, False, False, 6),
            row(next_week, True, True, 20), row(monday, True, None, 50)]
    found = {r.driver: r for r in marts.late_drivers(spark.createDataFrame(rows, columns), Params()).collect()}
    missed = found["Seller shipped after its deadline"]
    assert (missed.exposed_orders, missed.exposed_orders_compared) == (3, 2)
    assert missed.late_rate_exposed == pytest.approx(2 / 3) and missed.late_rate_not_exposed == 0
    assert missed.adjusted_late_rate_difference == pytest.approx(0.5)
    assert missed.adjusted_actual_days_difference == pytest.approx(5.0)
    assert missed.share_of_exposed_compared == pytest.approx(2 / 3)
    assert "Distance over 1,000 km" not in found  # unknown everywhere
    assert found["Paid by boleto (bank slip)"].adjusted_late_rate_difference is None  # nobody to compare with
