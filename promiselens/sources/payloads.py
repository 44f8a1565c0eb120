"""Reshapes API answers (parallel arrays, nested maps, text dates) into one row per day or month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAILY_VALUES = ["precipitation_sum", "temperature_2m_max", "temperature_2m_min"]


def daily_arrays_to_rows(payload: DataFrame, values: list[str] = DAILY_VALUES) -> DataFrame:
    """``daily`` = struct of parallel arrays -> one row per day; blanks in the arrays are kept."""
    zipped = F.arrays_zip(*[F.col(f"daily.{name}").alias(name) for name in ["time", *values]])
    return payload.select(
        "state_code",
        F.col("latitude").alias("grid_latitude"),
        F.col("longitude").alias("grid_longitude"),
        "timezone",
        F.inline(zipped),
    )


def rate_map_to_rows(payload: DataFrame, base: str = "EUR", quote: str = "BRL") -> DataFrame:
    """``rates`` = map of day to map of currency to rate -> one row per day."""
    return payload.where(F.col("base") == base).select(F.explode("rates").alias("date", "_quotes")).select(
        F.col("date").cast("date").alias("date"),
        F.lit(base).alias("base"),
        F.lit(quote).alias("quote"),
        F.try_element_at("_quotes", F.lit(quote)).alias("rate"),
    )


def monthly_text_to_rows(rows: DataFrame) -> DataFrame:
    """``data`` = dd/MM/yyyy and ``valor`` = text number (point or comma) -> month and number."""
    return rows.select(
        F.date_format(F.to_date("data", "dd/MM/yyyy"), "yyyy-MM").alias("month"),
        F.regexp_replace("valor", ",", ".").cast("double").alias("pct_change"),
    )


def coded_months_to_rows(rows: DataFrame) -> DataFrame:
    """``D3C`` = yyyyMM and ``V`` = text number; the first row of such an answer is a header."""
    return rows.where(F.col("D3C").rlike("^[0-9]{6}$")).select(
        F.date_format(F.to_date("D3C", "yyyyMM"), "yyyy-MM").alias("month"),
        F.regexp_replace("V", ",", ".").cast("double").alias("pct_change"),
    )


def feed_log(df: DataFrame, **counts) -> DataFrame:
    """One row for the run log: records and the named conditional counts."""
    return df.agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(condition).alias(name) for name, condition in counts.items()]
    )


def required_years(first: int, last: int, this_year: int, live_only: bool = False) -> list[int]:
    """Years a holiday list is needed for: the analysis years, this year and the next."""
    live = {this_year, this_year + 1}
    return sorted(live if live_only else live | set(range(first, last + 1)))
