"""Calendars: day rows, filled daily series and the bank-day index.

A calendar has one row per day between two known dates, so its size is arithmetic on the parameters
(checked against ``MAX_DAYS``); that is the bound behind every broadcast of a calendar here.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promiselens.functions import dates

MAX_DAYS = 40_000


def calendar_days(spark: SparkSession, start: date, end: date, column: str = "date_day") -> DataFrame:
    """Every day from start to end, both included."""
    days = (end - start).days + 1
    if not 0 <= days <= MAX_DAYS:
        raise ValueError(f"A calendar of {days} days ({start}..{end}) is outside 0..{MAX_DAYS}")
    return spark.range(0, days, 1, 1).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias(column)
    )


def forward_filled(
    days: DataFrame, series: DataFrame, day: str, value: str, published_flag: str
) -> DataFrame:
    """A sparse series on every calendar day: the last published value is carried forward.

    The window has no partition key; its input is the calendar, which is bounded.
    """
    up_to_today = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.join(series.select(day, value), day, "left").select(
        day,
        F.last(value, ignorenulls=True).over(up_to_today).alias(value),
        F.col(value).isNotNull().alias(published_flag),
    )


def bank_day_index(days: DataFrame, bank_holidays: DataFrame) -> DataFrame:
    """Calendar with ``is_bank_day`` and ``bank_day_no`` = bank days up to and including the day."""
    closed = bank_holidays.select(F.col("holiday_date").alias("date_day")).distinct().withColumn("_closed", F.lit(True))
    so_far = Window.orderBy("date_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_open = (dates.iso_weekday("date_day") <= 5) & F.col("_closed").isNull()
    return (
        days.join(closed, "date_day", "left")
        .select("date_day", is_open.alias("is_bank_day"))
        .withColumn("bank_day_no", F.count_if("is_bank_day").over(so_far))
    )


def bank_holidays_of(holidays: DataFrame) -> DataFrame:
    """Days on which banks are closed everywhere."""
    return holidays.where(F.col("is_nationwide") & (F.col("is_public_holiday") | F.col("is_bank_holiday")))


def _numbers(index: DataFrame, day: str, number: str) -> DataFrame:
    return F.broadcast(index.select(F.col("date_day").alias(day), F.col("bank_day_no").alias(number)))


def with_bank_days_between(df: DataFrame, start: str, end: str, index: DataFrame, out: str) -> DataFrame:
    """Bank days after ``start`` up to and including ``end``; 0 when ``end`` is not after ``start``.

    Unknown (null) when a day is unknown or outside the calendar.
    """
    between = F.col("_to_no") - F.col("_from_no")
    return (
        df.withColumn("_from_day", F.col(start).cast("date"))
        .withColumn("_to_day", F.col(end).cast("date"))
        .join(_numbers(index, "_from_day", "_from_no"), "_from_day", "left")
        .join(_numbers(index, "_to_day", "_to_no"), "_to_day", "left")
        .withColumn(out, F.when(between >= 0, between).when(between < 0, F.lit(0)))
        .drop("_from_day", "_to_day", "_from_no", "_to_no")
    )


def with_bank_days_added(df: DataFrame, day: str, bank_days: Column, index: DataFrame, out: str) -> DataFrame:
    """The day that lies ``bank_days`` bank days later; 0 gives the day itself."""
    targets = index.where("is_bank_day").select(
        F.col("bank_day_no").alias("_target_no"), F.col("date_day").alias("_target_day")
    )
    return (
        df.withColumn("_add", bank_days)
        .withColumn("_start", F.col(day).cast("date"))
        .join(_numbers(index, "_start", "_start_no"), "_start", "left")
        .withColumn("_target_no", F.col("_start_no") + F.col("_add"))
        .join(F.broadcast(targets), "_target_no", "left")
        .withColumn(out, F.when(F.col("_add") <= 0, F.col("_start")).otherwise(F.col("_target_day")))
        .drop("_add", "_start", "_start_no", "_target_no", "_target_day")
    )
