"""As-of join and forward fill over a whole timeline, without a window over all rows.

"The last value known at a time" needs rows in order, and without a key all of them are one sequence. Here the sequence is cut into
ranges of time of even size. Each range fills forward by itself; what a range does not know at its start is the last value of
the ranges before it, which is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.operators.ranking import ranges


def _filled(ranged: DataFrame, value: Column) -> DataFrame:
    """``ranged`` (see ``ranking.ranges``) with ``_last``: the last non-null ``value`` at or before each row."""
    inside = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The largest place with a value combines on the map side; one row a range is left.
    ends = ranged.groupBy("_part").agg(F.max_by(value, F.when(value.isNotNull(), F.col("_slot"))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    joined = ranged.withColumn("_inside", F.last(value, ignorenulls=True).over(inside)).join(F.broadcast(known), "_part")
    return joined.withColumn("_last", F.coalesce("_inside", "_start")).drop("_inside", "_start", "_part", "_slot")


def forward_filled(series: DataFrame, time: str, value: str) -> DataFrame:
    """``series`` with its null values replaced by the last value before them; null where there is none. Times are unique."""
    filled = _filled(ranges(series, time), F.col(value))
    return filled.withColumn(value, F.col("_last")).select(series.columns)


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str], tie: str) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time; of equal times that of the largest ``tie``.

    Rows of ``left`` without a time, or before the first row of ``right``, get nulls. Rows of ``right`` without a time are never
    known. Both sides are merged by time, so the cost is one sort of both, however unevenly the times lie.
    """
    columns = left.columns
    known = right.where(F.col(right_time).isNotNull()).groupBy(F.col(right_time).alias("_time")).agg(
        F.max_by(F.struct(*values), tie).alias("_values")
    )
    rows = left.select(F.col(left_time).alias("_time"), F.struct(*[F.col(c) for c in columns]).alias("_row"))
    # At equal times what is known comes first.
    merged = rows.withColumn("_values", F.lit(None).cast(known.schema["_values"].dataType)).unionByName(
        known.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    )
    ordered = ranges(merged, F.col("_time").asc_nulls_first(), F.col("_row").isNotNull())
    filled = _filled(ordered, F.col("_values")).where(F.col("_row").isNotNull())
    return filled.select(
        *[F.col("_row").getField(c).alias(c) for c in columns], *[F.col("_last").getField(v).alias(v) for v in values]
    )
