"""Lookup joins that pick a strategy from sizes and survive hot keys.

* The lookup side is small -> broadcast; the fact side is not shuffled. Catalyst's estimate follows the
  size of compressed files, so unless it is tiny the rows themselves are measured as memory holds them.
* A derived lookup looks large only because an aggregate keeps its input's estimate -> it is written
  out once, and its true size decides.
* Otherwise -> shuffle join in which hot keys (and null keys) are spread over salts.

Skew that is left over (many medium keys in one partition) is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promiselens.params import Params
from promiselens.session import materialise


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes carried through projections and filters)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


# Rows that lie sorted in a compressed file take this many times its size in the memory of a broadcast.
MOST_GROWTH = 64
# A row's share of the map of a broadcast beside its columns: slots of the key, pointers, lengths.
ROW_BYTES = 64


def held_bytes(df: DataFrame) -> int:
    """Bytes that a broadcast of ``df`` takes on the driver and on each executor: rows are counted, texts measured.

    A projection of a file without texts is counted from the file's footers.
    """
    fixed, varying = ROW_BYTES, F.lit(0)
    for field in df.schema.fields:
        fixed += 8
        if isinstance(field.dataType, T.DecimalType):
            fixed += 16
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            varying = varying + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            varying = varying + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    rows, texts = df.agg(F.count(F.lit(1)), F.sum(varying.cast("long"))).first()
    return rows * fixed + (texts or 0)


def is_small(df: DataFrame, params: Params) -> bool:
    """Whether ``df`` may be broadcast. Between an estimate that is tiny and one beyond the limit the rows are measured."""
    estimate, limit = estimated_bytes(df), params.broadcast_limit_bytes
    if estimate > limit or MOST_GROWTH * estimate <= limit:
        return estimate <= limit
    return held_bytes(df) <= limit


def measured(df: DataFrame, params: Params) -> DataFrame:
    """``df`` itself when its estimate is tiny, else its written copy, which is cheap to measure and to read again."""
    return df if MOST_GROWTH * estimated_bytes(df) <= params.broadcast_limit_bytes else materialise(df)


def _row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*columns)


def hot_keys(key_source: DataFrame, on: list[str], spread_by: list[str], params: Params) -> DataFrame:
    """Keys that hold about ``hot_key_rows`` rows or more, found in a hash sample of the rows.

    The sample is a function of the row, so every evaluation finds the same keys. A key missed or found
    by chance only changes where rows go, never the result. There are at most rows / hot_key_rows keys. A null
    key is among them when it is as frequent; it matches no row.
    """
    one_in = params.hot_key_sample
    sampled = key_source.where(F.pmod(_row_hash([*on, *spread_by]), F.lit(one_in)) == 0).select(*on)
    counted = sampled.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") >= max(params.hot_key_rows // one_in, 1)).drop("_rows")


def spread_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    key_source: DataFrame,
    params: Params,
    how: str = "left",
) -> DataFrame:
    """Join on ``on``; rows of hot keys are spread over ``params.salts`` tasks by a hash of ``spread_by``.

    ``key_source`` is the cheapest frame with (at least) the fact side's key counts, usually a raw table.
    The salt is a function of the row, so a recomputed task produces the same rows. Without a hot key the join is
    plain, and what is grouped by ``on`` afterwards needs no further shuffle.
    """
    # Both sides read the hot keys: they are found once, stored, and broadcast only while they are few.
    hot = materialise(hot_keys(key_source, on, spread_by, params).withColumn("_hot", F.lit(True)))
    found = hot.count()
    if not found:
        return fact.join(lookup, on, how)
    if found <= params.max_hot_keys:
        hot = F.broadcast(hot)
    no_match = F.lit(False)
    for name in on:
        no_match = no_match | F.col(name).isNull()
    # pmod of a different hash than the sample's, so that sampled rows are spread as well.
    salt = F.pmod(F.hash(*spread_by), F.lit(params.salts))
    salted_fact = (
        fact.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_hot") | no_match, salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    all_salts = F.sequence(F.lit(0), F.lit(params.salts - 1))
    salted_lookup = (
        lookup.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return salted_fact.join(salted_lookup, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: list[str],
    params: Params,
    how: str = "left",
    key_source: DataFrame | None = None,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Many-to-one join of a fact with a lookup table that is unique on ``on``.

    A lookup that can grow with the data names a ``key_source`` and ``spread_by`` for its large case. A
    derived table of bounded content names neither: it is measured, and joined plainly when it should
    turn out large after all.
    """
    if key_source is None:
        lookup = measured(lookup, params)
    if is_small(lookup, params):
        return fact.join(F.broadcast(lookup), on, how)
    if key_source is not None:
        return spread_join(fact, lookup, on, spread_by or on, key_source, params, how)
    return fact.join(lookup, on, how)


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """Select columns under new names: ``renamed(df, new='old')``."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])
