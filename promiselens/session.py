"""SparkSession settings the jobs rely on, and durable materialisation of a DataFrame."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. Each is safe to set on a session somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# On a cluster shuffles start with many small partitions, which adaptive execution then merges to size.
SHUFFLE_PARTITIONS_PER_CORE = 8
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Spark broadcasts by the size of compressed files and shuffle blocks; in memory rows take up to 64 times that
# (``joins.MOST_GROWTH``), so what it may broadcast unasked stays within the 64 MB of a measured lookup.
UNASKED_BROADCAST_BYTES = 1024 * 1024
BROADCAST_THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
ADAPTIVE_BROADCAST_THRESHOLD = "spark.sql.adaptive.autoBroadcastJoinThreshold"  # unset: as the other


def _limit_unasked_broadcasts(spark: SparkSession) -> None:
    """Lower Spark's thresholds to ``UNASKED_BROADCAST_BYTES``; smaller ones, and -1 for none, stay."""
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    held = {
        BROADCAST_THRESHOLD: spark.conf.get(BROADCAST_THRESHOLD),
        ADAPTIVE_BROADCAST_THRESHOLD: spark.conf.get(ADAPTIVE_BROADCAST_THRESHOLD, None),
    }
    for key, value in held.items():
        if value is not None and not value.startswith("-") and to_bytes(value) > UNASKED_BROADCAST_BYTES:
            spark.conf.set(key, str(UNASKED_BROADCAST_BYTES))


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    _limit_unasked_broadcasts(spark)
    context = spark.sparkContext
    if not context.master.startswith("local") and spark.conf.get(INITIAL_PARTITIONS, None) is None:
        spark.conf.set(INITIAL_PARTITIONS, str(SHUFFLE_PARTITIONS_PER_CORE * context.defaultParallelism))
    return spark


def build_session(app_name: str = "promiselens", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return apply_runtime_settings(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster that folder would be
    visible to one machine only, so a missing setting is an error there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="promiselens-checkpoint-"))
    return context.getCheckpointDir()


# Spark removes an execution's shuffle files at its end; otherwise they lie on disk until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Of tables that the jobs keep for themselves: ids, keys in hexadecimal and exact decimals take a quarter less than by default.
KEPT_CODEC = "zstd"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside, and collects of frames made inside, leave no shuffle files behind; for results that are computed once."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """As ``materialise``, for a table in parts that are written one after the other: one part's shuffles are on disk at a time."""
    parts = list(parts)
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/promiselens/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        for part in parts:
            part.write.mode("append").option("compression", KEPT_CODEC).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the written copy.

    Used where several branches would repeat a heavy job, or must see the very same rows. The copy is
    on shared storage, so it survives the loss of executors, and it carries true size statistics.
    """
    path = f"{shared_folder(df.sparkSession)}/promiselens/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
