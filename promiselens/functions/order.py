"""Orderings for "the best row of a group"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nulls_last(*keys: Column | str) -> Column:
    """A struct to take the minimum by: ascending in every key, an unknown value after all known ones.

    A descending key is passed negated; the negative of null is null, so it comes last as well.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.struct(*[part for c in columns for part in (c.isNull(), c)])
