"""Column functions, calendars, prices."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promiselens.functions import dates, geo, rules, stats, text
from promiselens.operators import calendars
from promiselens.params import Params
from promiselens.plans import fit

CHRISTMAS = date(2026, 12, 25)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ts(text_):
    return F.lit(text_).cast("timestamp_ntz")


def day(text_):
    return F.lit(text_).cast("date")


def test_minute_boundaries_count(spark):
    assert value(spark, dates.hours_between(ts("2018-01-01 10:00:50"), ts("2018-01-01 10:01:10"))) == pytest.approx(1 / 60)
    assert value(spark, dates.hours_between(ts("1969-12-31 23:59:30"), ts("1970-01-01 00:00:10"))) == pytest.approx(1 / 60)
    assert value(spark, dates.hours_between(ts("2018-01-02 10:00:00"), ts("2018-01-01 10:00:00"))) == -24
    assert value(spark, dates.seconds_between(ts("2018-01-01 10:00:00.9"), ts("2018-01-01 10:00:01.1"))) == 1


@pytest.mark.parametrize("text_, weekday, monday", [
    ("2018-01-01", 1, date(2018, 1, 1)), ("2018-01-07", 7, date(2018, 1, 1)), ("1995-01-01", 7, date(1994, 12, 26)),
])
def test_weekdays(spark, text_, weekday, monday):
    assert value(spark, dates.iso_weekday(day(text_))) == weekday
    assert value(spark, dates.week_start(day(text_))) == monday


def test_names_and_months(spark):
    assert value(spark, dates.month_name(F.lit(2))) == "Feb" and value(spark, dates.day_name(F.lit(7))) == "Sun"
    assert value(spark, dates.month_key(day("2026-01-15"), 2)) == "2025-11"
    assert value(spark, dates.in_season(day("2017-11-20"), "11-20", "12-31"))
    assert not value(spark, dates.in_season(day("2017-11-19"), "11-20", "12-31"))


@pytest.mark.parametrize("year, expected", [(2026, date(2026, 11, 27)), (2017, date(2017, 11, 24)), (2018, date(2018, 11, 23))])
def test_black_friday(spark, year, expected):
    assert value(spark, dates.black_friday(F.lit(year))) == expected


def test_distance(spark):
    lisbon_like = geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    assert value(spark, lisbon_like) == pytest.approx(6371 * 3.141592653589793)
    assert value(spark, geo.haversine_km(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))) is None


def test_bands(spark):
    frame = spark.createDataFrame([(None,), (499.0,), (500.0,), (2000.0,), (10000.0,)], "weight_g double")
    labels = [r.v for r in frame.select(rules.weight_band().alias("v")).collect()]
    assert labels == ["Unknown", "1: under 0.5 kg", "2: 0.5-2 kg", "3: 2-10 kg", "4: over 10 kg"]
    frame = spark.createDataFrame([(0,), (1,), (2,), (3,), (7,), (8,), (14,), (15,)], "days_late int")
    labels = [r.v[0] for r in frame.select(rules.days_late_band().alias("v")).collect()]
    assert labels == ["0", "1", "1", "2", "2", "3", "3", "4"]


def test_text_helpers(spark):
    frame = spark.createDataFrame([("", ["a", None], None), ("x", None, "SP")], "c string, l array<string>, s string")
    rows = frame.select(
        text.blank_to_null("c").alias("c"), text.contains("l", "b").alias("l"), text.route_label("s", "c").alias("r")
    ).collect()
    assert [tuple(r) for r in rows] == [(None, False, None), ("x", False, "SP -> x")]
    keys = spark.createDataFrame([("1", "a"), (None, "a"), ("", "a")], "a string, b string").select(text.row_key("a", "b"))
    assert keys.distinct().count() == 3


def test_ratio_and_percentiles(spark):
    assert value(spark, stats.safe_ratio(F.lit(1), F.lit(0))) is None
    frame = spark.range(1, 101).select(F.col("id").alias("x"))
    row = frame.agg(
        stats.discrete_percentile("x", 0.9).alias("d"), stats.continuous_percentile("x", 0.9).alias("c"),
        stats.discrete_percentile("x", 0.9, approximate=True).alias("a"), stats.percentile_grid("x").alias("g"),
    ).first()
    assert (row.d, row.c, row.a) == (90, pytest.approx(90.1), 90)
    assert len(row.g) == len(stats.PERCENTILE_GRID) and (row.g[0], row.g[-1]) == (1, 100)


@pytest.fixture(scope="module")
def bank_calendar(spark):
    closed = spark.createDataFrame([(CHRISTMAS,)], "holiday_date date")
    days = calendars.calendar_days(spark, date(2026, 9, 1), date(2027, 1, 31))
    return calendars.bank_day_index(days, closed)


@pytest.mark.parametrize("start, lag, expected", [
    (date(2026, 12, 24), 1, date(2026, 12, 28)), (date(2026, 10, 2), 1, date(2026, 10, 5)),
    (date(2026, 10, 3), 0, date(2026, 10, 3)), (date(2026, 10, 3), 2, date(2026, 10, 6)),
])
def test_bank_days_added(spark, bank_calendar, start, lag, expected):
    frame = spark.createDataFrame([(start,)], "d date")
    assert calendars.with_bank_days_added(frame, "d", F.lit(lag), bank_calendar, "out").first().out == expected


@pytest.mark.parametrize("start, end, expected", [
    (date(2026, 10, 2), date(2026, 10, 5), 1), (date(2026, 10, 2), date(2026, 10, 2), 0),
    (date(2026, 12, 23), date(2026, 12, 28), 2), (date(2026, 10, 5), date(2026, 10, 2), 0),
])
def test_bank_days_between(spark, bank_calendar, start, end, expected):
    frame = spark.createDataFrame([(start, end)], "a date, b date")
    assert calendars.with_bank_days_between(frame, "a", "b", bank_calendar, "out").first().out == expected


def test_calendar_is_inclusive_and_bounded(spark):
    days = calendars.calendar_days(spark, date(2020, 2, 28), date(2020, 3, 1))
    assert [r.date_day.day for r in days.orderBy("date_day").collect()] == [28, 29, 1]
    with pytest.raises(ValueError):
        calendars.calendar_days(spark, date(1800, 1, 1), date(2026, 1, 1))


def test_prices_follow_the_index_known_two_months_earlier(spark):
    levels = {date(2017, 6, 1): 1.0, date(2018, 1, 1): 1.02, date(2026, 6, 1): 1.55, date(2026, 7, 1): 1.56,
              date(2026, 8, 1): 1.55}
    changes, before = [], 1.0
    for month, level in levels.items():
        changes.append((month, (level / before - 1) * 100))
        before = level
    inflation = spark.createDataFrame(changes, "month_start date, pct_change double")
    months = spark.createDataFrame([(date(2026, 10, 1),), (date(2026, 12, 1),)], "month_start date")
    found = {r.month_start.month: r.price_factor
             for r in fit.price_factors(inflation, months, date(2018, 1, 1), Params()).collect()}
    assert found[10] == pytest.approx(1.55 / 1.02)
    assert found[12] == pytest.approx(1.55 / 1.02)  # September and October are not published yet


def test_rescaled_payments_add_up_to_the_cent(spark):
    payments = spark.createDataFrame(
        [("o", 1, "credit_card", 3, Decimal(100)), ("o", 2, "voucher", 1, Decimal(20)), ("z", 1, "boleto", 1, Decimal(0))],
        "order_id string, payment_sequence int, payment_type string, installments int, payment_brl decimal(28,6)",
    )
    totals = spark.createDataFrame([("o", Decimal("187.33")), ("z", Decimal("5.00"))], "order_id string, new_total decimal(28,6)")
    rows = fit.rescaled_payments(payments, totals, Params()).orderBy("order_id", "payment_sequence").collect()
    assert sum(r.scaled_brl for r in rows if r.order_id == "o") == Decimal("187.33")
    assert [r.payment_type for r in rows] == ["credit_card", "voucher", "boleto"]
    assert rows[0].scaled_brl == Decimal("156.11") and rows[2].scaled_brl == Decimal("5.00")
