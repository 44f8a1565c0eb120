"""Unknown values never win a group, never become zero, and never lose a cent."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promiselens.operators import calendars
from promiselens.params import Params
from promiselens.plans import fit, summaries

REVIEWS = "review_id string, order_id string, review_score int, has_comment boolean, review_sent_date date, review_answered_at timestamp_ntz"
PAYMENTS = "order_id string, payment_sequence int, payment_type string, installments int, payment_brl decimal(28,6)"


def test_unanswered_review_is_not_the_latest(spark):
    day = date(2018, 1, 11)
    rows = [
        ("a", "o", 1, False, day, None),
        ("b", "o", 5, False, day, datetime(2018, 1, 12)),
        ("c", "o", 3, False, None, datetime(2018, 1, 12)),
        (None, "o", 2, False, day, datetime(2018, 1, 12)),
    ]
    latest = summaries.latest_reviews(spark.createDataFrame(rows, REVIEWS)).first()
    assert (latest.review_id, latest.review_score, latest.reviews_for_order) == ("b", 5, 4)


def test_unknown_payment_is_not_the_main_one(spark):
    rows = [
        ("o", 1, "voucher", 1, None), ("o", None, "boleto", 1, Decimal(100)), ("o", 3, "credit_card", 1, Decimal(100)),
        ("o", 3, None, 1, Decimal(100)),
    ]
    found = summaries.payments_summary(spark.createDataFrame(rows, PAYMENTS)).first()
    assert (found.main_payment_type, found.payment_count, found.paid_brl) == ("credit_card", 4, Decimal(300))


def test_seller_without_a_price_is_not_the_primary_one(spark):
    rows = [("o", "s1", None, Decimal(1)), ("o", "s2", Decimal(100), Decimal(1)), ("o", None, Decimal(100), Decimal(1))]
    items = spark.createDataFrame(
        rows, "order_id string, seller_id string, price_brl decimal(28,6), freight_brl decimal(28,6)"
    ).withColumn("shipping_limit_at", F.lit(None).cast("timestamp_ntz"))
    assert summaries.items_summary(items).first().primary_seller_id == "s2"


@pytest.mark.parametrize("total", ["100.02", "0.01", "76.66", "999.99"])
def test_rescaled_payments_add_up_to_the_cent(spark, total):
    rows = [("o", 1, "boleto", 1, Decimal("33.33"))] * 2 + [("o", 2, "voucher", 1, Decimal("10.00")), ("o", 3, "voucher", 1, None)]
    totals = spark.createDataFrame([("o", Decimal(total))], "order_id string, new_total decimal(28,6)")
    found = fit.rescaled_payments(spark.createDataFrame(rows, PAYMENTS), totals, Params()).collect()
    assert len(found) == 4 and sum(r.scaled_brl for r in found if r.scaled_brl is not None) == Decimal(total)


def test_days_outside_the_calendar_are_unknown(spark):
    days = calendars.calendar_days(spark, date(2018, 1, 1), date(2018, 1, 31))
    index = calendars.bank_day_index(days, spark.createDataFrame([], "holiday_date date"))
    rows = [
        ("inside", date(2018, 1, 1), date(2018, 1, 8)), ("back", date(2018, 1, 8), date(2018, 1, 1)),
        ("past the end", date(2018, 1, 30), date(2018, 2, 20)), ("no end", date(2018, 1, 30), None),
        ("before", date(2017, 12, 1), date(2018, 1, 3)),
    ]
    df = spark.createDataFrame(rows, "k string, a date, b date")
    found = {r.k: r.n for r in calendars.with_bank_days_between(df, "a", "b", index, "n").collect()}
    assert found == {"inside": 5, "back": 0, "past the end": None, "no end": None, "before": None}


def test_calendar_covers_every_day_of_the_orders(spark):
    from types import SimpleNamespace

    schema = "purchased_at timestamp_ntz, approved_at timestamp_ntz, shipped_at timestamp_ntz, delivered_at timestamp_ntz, promised_date date"
    orders = spark.createDataFrame([(datetime(2016, 1, 1), None, None, None, date(2019, 6, 1))], schema)
    holidays = spark.createDataFrame([], "holiday_date date, is_nationwide boolean, is_public_holiday boolean, is_bank_holiday boolean")
    feed = SimpleNamespace(spark=spark, orders=orders, holidays=holidays)
    params = Params(calendar_start=date(2017, 1, 1), calendar_end=date(2018, 1, 1))
    span = fit.bank_calendar(feed, params).agg(F.min("date_day"), F.max("date_day")).first()
    assert span[0] == date(2016, 1, 1) and span[1] > date(2019, 6, 1)
