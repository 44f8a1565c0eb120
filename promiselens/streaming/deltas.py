"""The difference of two stored snapshots, read only where they differ.

A snapshot is stored in buckets (a cluster such as the purchase month, and a hash of the key inside it) beside a small table of
sums: rows, rows per status, and two checksums over all columns of each bucket. Two snapshots are compared by their sums
first; only buckets with unequal sums are opened and joined. Orders of past months no longer change, so a day's difference
reads the last months of a history of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.functions.stats import count_where
from promiselens.sources import sinks

SUMS = ["rows", "shipped", "delivered", "sum_check", "xor_check"]


def bucketed(df: DataFrame, key: str, cluster: Column, hashes: int) -> DataFrame:
    """``df`` with its bucket: the cluster's text and one of ``hashes`` hash values of the key."""
    part = F.pmod(F.xxhash64(key), F.lit(hashes)).cast("string")
    # A name that partition discovery cannot take for a date or a number.
    return df.withColumn("bucket", F.concat_ws("_h", F.coalesce(cluster.cast("string"), F.lit("none")), part))


def bucket_sums(rows: DataFrame, ignore: list[str]) -> DataFrame:
    """One row a bucket. A null differs from every value; the order of rows does not matter.

    The checksums are 64 bits each, a sum and an exclusive or, so unequal buckets look equal with a chance near 2**-128.
    """
    columns = sorted(c for c in rows.columns if c not in [*ignore, "bucket"])
    hashed = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])
    status = F.col("order_status") if "order_status" in rows.columns else F.lit(None).cast("string")
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(status == "shipped").alias("shipped"),
        count_where(status == "delivered").alias("delivered"),
        F.sum(hashed.cast("decimal(38,0)")).alias("sum_check"),
        F.bit_xor(hashed).alias("xor_check"),
    )


def store_snapshot(df: DataFrame, root: str, key: str, cluster: Column, hashes: int = 16, ignore: tuple[str, ...] = ("sim_as_of",)) -> None:
    """Write a snapshot and its sums below ``root`` and commit both together. ``ignore``: columns that are no change."""
    rows = bucketed(df, key, cluster, hashes)
    data = sinks.write_version(rows.hint("rebalance", "bucket"), f"{root}/rows", "bucket")
    written = sinks.read_version(df.sparkSession, f"{root}/rows", data)
    sums = sinks.write_version(bucket_sums(written, list(ignore)), f"{root}/sums")
    sinks.commit(df.sparkSession, root, {"rows": data, "sums": sums})


def unequal_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket) of the sums that are not the same, or on one side only."""
    old, new = before.select("bucket", F.struct(*SUMS).alias("_old")), after.select("bucket", F.struct(*SUMS).alias("_new"))
    joined = old.join(new, "bucket", "full")
    return joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("bucket")


def changed_rows(spark: SparkSession, before: str, after: str, key: str, values: list[str]) -> DataFrame:
    """(key, was_there, is_there, <value>_was, <value>) of the keys in unequal buckets, other buckets are not opened.

    A key must keep its cluster from snapshot to snapshot, as an order keeps its purchase month.
    """
    old, new = sinks.read_generation(spark, before), sinks.read_generation(spark, after)
    # Joined with the partition column, so the scans of both sides are pruned to these partitions when the query runs.
    unequal = unequal_buckets(old["sums"], new["sums"])

    def side(rows: DataFrame, there: str, suffix: str) -> DataFrame:
        touched = rows.join(F.broadcast(unequal), "bucket", "left_semi")
        return touched.select("bucket", key, F.lit(True).alias(there), *[F.col(v).alias(v + suffix) for v in values])

    joined = side(old["rows"], "was_there", "_was").join(side(new["rows"], "is_there", ""), ["bucket", key], "full").drop("bucket")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("was_there", "is_there")})


def order_changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """One row: totals from the sums, changes from the unequal buckets."""
    sums = sinks.read_table(spark, after, "sums")
    totals = sums.agg(F.sum("rows").alias("orders_total"), F.sum("shipped").alias("in_transit"), F.sum("delivered").alias("delivered_total"))
    changed = changed_rows(spark, before, after, "order_id", ["order_status"])
    both, now, was = F.col("was_there") & F.col("is_there"), F.col("order_status"), F.col("order_status_was")
    counts = changed.agg(
        count_where(~F.col("was_there")).alias("new_orders"),
        count_where(both & (was != now)).alias("orders_changed_status"),
        count_where(both & (now == "delivered") & (was != "delivered")).alias("newly_delivered"),
    )
    total = {c: totals.select(c).scalar() for c in totals.columns}
    return counts.withColumns({c: F.coalesce(v, F.lit(0)) for c, v in total.items()})
