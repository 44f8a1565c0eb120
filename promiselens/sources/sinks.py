"""Writers that never harm what is there: new versions are written in full before anything points at them.

A root folder holds one sub-folder per table with one folder per written version, and in ``generations`` one small
row per commit: a number, and the version of every table. A reader takes all tables from one row, so it sees either all
tables of a run or none, wherever a run stops. Generations are ordered by their numbers, not by clocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promiselens.session import shuffles_dropped


def with_lineage(df: DataFrame, source: str | Column, ingested_at: str) -> DataFrame:
    """Where and when each record was fetched: one timestamp for all records of a run."""
    origin = F.lit(source) if isinstance(source, str) else source
    return df.withColumns({"_source_url": origin, "_ingested_at": F.lit(ingested_at)})


def write_ndjson(df: DataFrame, path: str) -> None:
    """A new landing folder; an existing one is an error, as overwriting would delete it before it is replaced."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv_text(df: DataFrame, path: str) -> None:
    """A text snapshot with header: timestamps to the second, nulls as blanks."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.cast("string").alias(field.name))
    writer = df.select(*columns).write.mode("errorifexists").option("header", True)
    writer.option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def exportable(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, the type dashboard readers handle best."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export_parquet(tables: dict[str, DataFrame], root: str, partition_by: dict[str, str] | None = None) -> None:
    """All tables are written, then one commit makes them the current ones below ``root``."""
    partitions = partition_by or {}
    versions = {name: write_version(exportable(df), f"{root}/{name}", partitions.get(name)) for name, df in tables.items()}
    commit(next(iter(tables.values())).sparkSession, root, versions)


def replace_table(df: DataFrame, name: str) -> str:
    """Full refresh: a new table is written first, then the view ``name`` is pointed at it.

    A failing write leaves the view on the old table.
    """
    target = f"{name}__{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").format("parquet").saveAsTable(target)
    df.sparkSession.sql(f"create or replace view {name} as select * from {target}")
    return target


def write_version(
    df: DataFrame | list[DataFrame], folder: str, partition_by: str | None = None, codec: str | None = None
) -> str:
    """Write a new version of the table in ``folder`` without pointing to it; returns its name.

    A table in several parts is written part by part, each with its shuffles removed before the next.
    """
    version = f"v-{uuid.uuid4().hex[:12]}"
    for n, part in enumerate([df] if isinstance(df, DataFrame) else df):
        writer = part.write.mode("append" if n else "errorifexists")
        writer = writer.option("compression", codec) if codec else writer
        with shuffles_dropped(part.sparkSession):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{folder}/{version}")
    return version


_BUCKETS = re.compile(r"_b(\d+)_(\w+)$")


def write_bucketed(df: DataFrame, folder: str, key: str, buckets: int) -> str:
    """As ``write_version``, in buckets of a hash of ``key``: joins and groupings by ``key`` of tables with as many buckets need no shuffle.

    The version's name tells the buckets, so any session can read them. A bucket is one file and one task, so a
    table in which one key holds very many rows should not be written this way.
    """
    version = f"v-{uuid.uuid4().hex[:12]}_b{buckets}_{key}"
    writer = df.repartition(buckets, key).write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{folder}/{version}").saveAsTable(_bucket_table(version))
    return version


def _bucket_table(version: str) -> str:
    return f"promiselens_{version.replace('-', '_')}"


_GENERATION = "number long, id string, tables map<string,string>"


class CommitConflict(RuntimeError):
    """Another run has committed the generation that this one was about to."""


def generations(spark: SparkSession, root: str) -> DataFrame:
    """(number, tables, id) of every commit below ``root``, one row a number.

    If two runs commit one number at the same moment, the row of the smaller id counts for every reader.
    """
    try:
        rows = spark.read.schema(_GENERATION).parquet(f"{root}/generations")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _GENERATION)
    return rows.groupBy("number").agg(F.min_by("tables", "id").alias("tables"), F.min("id").alias("id"))


def latest_generation(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """(number, version of each table) of the last commit; (0, {}) before the first."""
    newest = generations(spark, root).orderBy(F.desc("number")).select("number", "tables").first()
    return (newest["number"], newest["tables"]) if newest else (0, {})


def commit(spark: SparkSession, root: str, versions: dict[str, str], based_on: int | None = None) -> int:
    """Make ``versions`` the current tables below ``root``: one row in one file, there as a whole or not at all.

    Tables that ``versions`` does not name keep the version they have. With ``based_on`` the commit fails unless that is still the
    latest generation, so a run that read old tables cannot replace newer ones. Of two runs that commit the same number one
    gets ``CommitConflict``, and readers see the other's.
    """
    number, before = latest_generation(spark, root)
    if based_on is not None and based_on != number:
        raise CommitConflict(f"{root}: generation {number} follows {based_on}")
    mine = uuid.uuid4().hex
    row = spark.createDataFrame([(number + 1, mine, {**before, **versions})], _GENERATION)
    row.coalesce(1).write.mode("append").parquet(f"{root}/generations")
    if generations(spark, root).where(F.col("number") == number + 1).first()["id"] != mine:
        raise CommitConflict(f"{root}: generation {number + 1} belongs to another run")
    return number + 1


def read_generation(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """All tables of one generation below ``root``, the latest by default."""
    if number is None:
        found = latest_generation(spark, root)[1]
    else:
        row = generations(spark, root).where(F.col("number") == number).first()
        found = row["tables"] if row else {}
    if not found:
        raise FileNotFoundError(f"{root} has no such finished generation")
    return {name: read_version(spark, f"{root}/{name}", version) for name, version in found.items()}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of one table below ``root``."""
    version = latest_generation(spark, root)[1].get(name)
    if version is None:
        raise FileNotFoundError(f"{root} has no finished version of {name}")
    return read_version(spark, f"{root}/{name}", version)


def expire(spark: SparkSession, root: str, keep: int = 7) -> list[str]:
    """Drop the versions that only generations before the last ``keep`` name; returns their folders.

    A version that no generation names may belong to a run under way, so it stays. Call it when no reader holds a generation that
    old. The driver handles one row a generation, never data.
    """
    if keep < 1:
        raise ValueError("the latest generation always stays")
    rows = generations(spark, root).orderBy(F.desc("number")).select("tables").collect()
    named = [{f"{name}/{version}" for name, version in row["tables"].items()} for row in rows]
    kept = set().union(*named[:keep])
    old = sorted(set().union(*named[keep:]) - kept)
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    dropped = []
    for folder in old:
        path = files.Path(f"{root}/{folder}")
        if path.getFileSystem(conf).delete(path, True):
            dropped.append(folder)
    return dropped


def read_version(spark: SparkSession, folder: str, version: str) -> DataFrame:
    buckets = _BUCKETS.search(version)
    if not buckets:
        return spark.read.parquet(f"{folder}/{version}")
    table = _bucket_table(version)
    if not spark.catalog.tableExists(table):  # another session has written it
        fields = spark.read.parquet(f"{folder}/{version}").schema.fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        number, key = buckets.groups()
        spark.sql(
            f"create table {table} ({columns}) using parquet clustered by ({key}) sorted by ({key}) "
            f"into {number} buckets location '{folder}/{version}'"
        )
    return spark.table(table)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The finished table below ``path``, built and written when there is none.

    What a failed job left behind is never committed, so it is never read.
    """
    if not latest_generation(spark, path)[0]:
        commit(spark, path, {"table": write_version(build(), f"{path}/table")})
    return read_table(spark, path, "table")
