"""Checks on dated series. Each returns violations; an empty result is a pass.

A series may hold many keys (states, currency pairs): pass them as ``by`` and every window is keyed.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.functions import dates


def missing_fields(df: DataFrame, required: list[str]) -> list[str]:
    """Required fields the schema does not have."""
    return sorted(set(required) - set(df.columns))


def missing_values(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows in which a required field is null."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required]))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: the feed is empty")
    return df


def wrong_partition(df: DataFrame, day: str, year: int, **expected: str) -> DataFrame:
    """Rows of another year, or whose column differs from the expected constant."""
    wrong = F.year(day) != year
    for column, value in expected.items():
        wrong = wrong | (F.col(column) != value)
    return df.where(F.coalesce(wrong, F.lit(True)))


def implausible(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is missing or outside the plausible range."""
    return df.where(~F.coalesce(F.col(column).between(low, high), F.lit(False)))


def gaps(df: DataFrame, day: str, max_gap_days: int, *by: str) -> DataFrame:
    """Neighbouring days of a series that lie further apart than allowed."""
    ordered = Window.partitionBy(*by).orderBy(day)
    days = df.select(*by, day).distinct().withColumn("previous_day", F.lag(day).over(ordered))
    return days.withColumn("gap_days", F.datediff(day, "previous_day")).where(F.col("gap_days") > max_gap_days)


def missing_months(df: DataFrame, month: str, *by: str) -> DataFrame:
    """Months that do not follow their predecessor directly, with the number of months left out."""
    ordered = Window.partitionBy(*by).orderBy(month)
    months = df.select(*by, month).distinct().withColumn("previous_month", F.lag(month).over(ordered))
    left_out = dates.month_number(month) - dates.month_number("previous_month") - 1
    return months.withColumn("months_missing", left_out).where("months_missing <> 0")


def uncovered(df: DataFrame, day: str, start: date, end: date, max_lag_days: int = 5) -> DataFrame:
    """One row when the series starts after ``start`` or ends more than ``max_lag_days`` before ``end``."""
    span = df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    covered = (F.col("first_day") <= F.lit(start)) & (
        F.datediff(F.lit(end), F.col("last_day")) <= max_lag_days
    )
    return span.where(~F.coalesce(covered, F.lit(False)))


def stale(df: DataFrame, month: str, today: date, max_months: int = 3) -> DataFrame:
    """One row when the latest month is missing or older than ``max_months``."""
    age = dates.month_number(F.lit(today)) - dates.month_number("latest_month")
    latest = df.agg(F.max(month).alias("latest_month")).withColumn("months_old", age)
    return latest.where(F.coalesce(F.col("months_old") > max_months, F.lit(True)))


def incomplete_days(df: DataFrame, days: str, start: date, end: date, values: list[str]) -> DataFrame:
    """Rows of parallel arrays whose day list is not exactly start..end, or whose values have another length."""
    expected = F.transform(
        F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day")), lambda d: F.date_format(d, "yyyy-MM-dd")
    )
    length = (end - start).days + 1
    bad = F.coalesce(F.col(days) != expected, F.lit(True))
    for column in values:
        bad = bad | (F.coalesce(F.size(column), F.lit(-1)) != length)
    return df.where(bad)


def without_trailing_blanks(df: DataFrame, day: str, value: str, *by: str) -> DataFrame:
    """Drops the days after the last day with a value, per key; blanks in between stay."""
    last = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max(day).alias("_last"))
    return df.join(last, list(by)).where(F.col(day) <= F.col("_last")).drop("_last")


def of_keys(df: DataFrame, column: str, wanted: list[str] | None) -> DataFrame:
    """Rows of the wanted keys (states, say); no list means all."""
    return df.where(F.upper(column).isin([w.upper() for w in wanted])) if wanted else df


def first_valid_source(sources: dict[str, DataFrame], violations: dict[str, list[DataFrame]]) -> DataFrame:
    """All rows of the first source (in order) without a violation; none when every source fails.

    Each source's violations are reduced to one number first, so the choice is a scalar and the rows
    are filtered in place.
    """
    verdicts = []
    labelled = []
    for priority, (name, df) in enumerate(sources.items()):
        count = F.lit(0)
        for found in violations.get(name, []):
            count = count + found.agg(F.count(F.lit(1))).scalar()
        verdicts.append(F.when(count == 0, F.lit(priority)))
        labelled.append(df.withColumns({"source": F.lit(name), "_priority": F.lit(priority)}))
    chosen: Column = F.coalesce(*verdicts, F.lit(len(labelled)))
    return reduce(DataFrame.unionByName, labelled).where(F.col("_priority") == chosen).drop("_priority")
