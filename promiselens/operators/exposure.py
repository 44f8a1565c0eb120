"""Exposure of an order to events in a fixed window of days after a start day.

The range join "event between start and start + n" is turned round: the small event table is
expanded once to "window starting on day d in state s", so the fact side needs one equi-join and is
never exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_totals(events: DataFrame, state: str, day: str, days: int, **measures: Column) -> DataFrame:
    """Per (state, start day): aggregates over the events in [start day, start day + days - 1]."""
    starts = F.explode(F.sequence(F.date_sub(F.col(day), days - 1), F.col(day)))
    return (
        events.withColumn("_start_day", starts)
        .groupBy(F.col(state).alias("_state"), "_start_day")
        .agg(*[expression.alias(name) for name, expression in measures.items()])
    )
