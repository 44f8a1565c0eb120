"""Mergeable percentiles: quantile sketches of fine cells, rolled up to any coarser level without reading rows again.

A sketch of size k answers a percentile with a rank error of about 2.3 / k**0.97 of the cell's rows, whatever is merged into it
(``rank_error``). Whether a percentile is exact or sketched is the caller's choice and never follows from the data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Rank error that a sketch of this size keeps in 99 of 100 answers, as a share of the rows."""
    return 2.296 / size**0.9723


def sketched(df: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """One sketch of the whole numbers ``value`` for each cell; unknown values are left out, and cells without others."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), size).alias("sketch"))


def rolled_up(cells: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Sketches of coarser cells from those of finer ones."""
    return cells.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", size).alias("sketch"))


def rows_of(sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_n_bigint(sketch)


def percentile_of(p: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(p))
