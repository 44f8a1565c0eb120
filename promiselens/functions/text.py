"""Text, array and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def contains(array_column: str, value) -> Column:
    """Array membership; a null array or a null element means 'not contained'."""
    return F.coalesce(F.array_contains(F.col(array_column), value), F.lit(False))


def row_key(*columns: str) -> Column:
    """Hash key of several columns. A null part is marked, so (null, 'a') and ('', 'a') differ."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("_null_")) for c in columns]
    return F.md5(F.concat_ws("-", *parts))


def route_label(seller_state: str, customer_state: str) -> Column:
    """'SP -> RJ'; null when either side is unknown."""
    return F.concat(F.col(seller_state), F.lit(" -> "), F.col(customer_state))
