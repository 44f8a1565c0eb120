"""Date and time expressions. All accept columns or column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names as the result tables print them.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def days_between(start, end) -> Column:
    """Signed whole calendar days from ``start`` to ``end``."""
    return F.datediff(_col(end), _col(start))


def _minute_number(ts) -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _col(ts))
    return F.floor(micros / F.lit(60_000_000))


def hours_between(start, end) -> Column:
    """Minute boundaries crossed between two timestamps, in hours."""
    return (_minute_number(end) - _minute_number(start)) / F.lit(60.0)


def minutes_between(start, end) -> Column:
    return _minute_number(end) - _minute_number(start)


def seconds_between(start, end) -> Column:
    """Second boundaries crossed between two timestamps."""
    def second(ts):
        return F.floor(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _col(ts)) / F.lit(1_000_000))

    return second(end) - second(start)


def iso_weekday(day) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(_col(day)) + F.lit(1)


def week_start(day) -> Column:
    """Monday of the week of ``day``."""
    return F.date_sub(_col(day), F.weekday(_col(day)))


def month_start(day) -> Column:
    return F.trunc(_col(day), "month")


def year_month(day) -> Column:
    return F.date_format(_col(day), "yyyy-MM")


def month_key(day, months_back: int = 0) -> Column:
    """``yyyy-MM`` of the month ``months_back`` before the month of ``day``."""
    return year_month(F.add_months(month_start(day), -months_back))


def month_name(month_number) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), _col(month_number))


def day_name(weekday_number) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), _col(weekday_number))


def black_friday(year) -> Column:
    """The day after the fourth Thursday of November."""
    before_november = F.make_date(_col(year), F.lit(10), F.lit(31))
    return F.date_add(F.next_day(before_november, "Thu"), 22)


def in_season(day, start_mmdd: str, end_mmdd: str) -> Column:
    return F.date_format(_col(day), "MM-dd").between(start_mmdd, end_mmdd)


def month_number(day) -> Column:
    """Months since year 0, so neighbouring months differ by one."""
    return F.year(_col(day)) * 12 + F.month(_col(day)) - 1
