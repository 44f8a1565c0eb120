"""Aggregate and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The percentiles a fitted distribution is stored at (finer steps in the tail).
PERCENTILE_GRID = [*range(0, 91, 5), 92, 94, 96, 97, 98, 99, 99.5, 100]


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def count_where(condition: Column) -> Column:
    """Rows where the condition is true; unknown counts as false."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def safe_ratio(numerator, denominator) -> Column:
    """Double ratio, null when the denominator is zero."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def share_where(condition: Column) -> Column:
    """Share of rows where the condition is true (unknown counts as false)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def avg_where(condition: Column, value) -> Column:
    return F.avg(F.when(condition, _col(value)))


def discrete_percentile(column: str, p: float, approximate: bool = False) -> Column:
    """An observed value, not an interpolation. ``approximate`` keeps a bounded sketch per group."""
    if approximate:
        return F.percentile_approx(column, p, 10_000)
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def continuous_percentile(column, p) -> Column:
    return F.percentile(_col(column), p)


def percentile_grid(column) -> Column:
    """Array of values at the fixed grid (linear interpolation)."""
    return F.percentile(_col(column), [g / 100 for g in PERCENTILE_GRID])
