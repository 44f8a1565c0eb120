"""The raw tables: which landed files make which table, and how they are read.

CSV columns are all text on purpose (leading zeros of zip prefixes survive); types come in staging.
NDJSON tables have an explicit schema, so reading them needs no inference scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.session import materialise
from promiselens.sources.digests import digests

LINEAGE = "_source_url string, _ingested_at string"
LABELS = "data_source is_synthetic sim_as_of"

# Column names of the landed files.
ORDERS = (
    "order_id customer_id order_status order_purchase_timestamp order_approved_at order_delivered_carrier_date "
    "order_delivered_customer_date order_estimated_delivery_date"
)
ITEMS = "order_id order_item_id product_id seller_id shipping_limit_date price freight_value"
PAYMENTS = "order_id payment_sequential payment_type payment_installments payment_value"
REVIEWS = (
    "review_id order_id review_score review_comment_title review_comment_message review_creation_date "
    "review_answer_timestamp"
)
CUSTOMERS = "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state"
SELLERS = "seller_id seller_zip_code_prefix seller_city seller_state"
PRODUCTS = (
    "product_id product_category_name product_name_lenght product_description_lenght product_photos_qty "
    "product_weight_g product_length_cm product_height_cm product_width_cm"
)
GEOLOCATION = (
    "geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city geolocation_state"
)
CATEGORIES = "product_category_name product_category_name_english"
HOLIDAYS = (
    "date string, localName string, name string, countryCode string, fixed boolean, global boolean, "
    "counties array<string>, launchYear int, types array<string>, " + LINEAGE
)
WEATHER = (
    "state_code string, grid_latitude double, grid_longitude double, timezone string, time string, "
    "precipitation_sum double, temperature_2m_max double, temperature_2m_min double, " + LINEAGE
)
RATES = "date string, base string, quote string, rate double, " + LINEAGE
INFLATION = "month string, pct_change double, " + LINEAGE


@dataclass(frozen=True)
class RawTable:
    name: str
    pattern: str  # glob below the landing folder; all matching files make one table
    columns: str  # blank-separated text columns (CSV) or a DDL schema (NDJSON)
    file_format: str = "csv"
    # Only free text can hold line breaks. Other files stay splittable.
    multi_line: bool = False

    def read(self, spark: SparkSession, root: str, rejected: str | None = None) -> DataFrame:
        """The records as text. With ``rejected``, a column of that name holds the text of records that do not parse, else null."""
        path = f"{root}/{self.pattern}"
        reader = spark.read.option("columnNameOfCorruptRecord", rejected) if rejected else spark.read
        extra = f", `{rejected}` string" if rejected else ""
        try:
            if self.file_format == "ndjson":
                return reader.schema(self.columns + extra).json(path)
            schema = ", ".join(f"`{c}` string" for c in self.columns.split()) + extra
            return (
                reader.schema(schema)
                .option("header", True)
                .option("enforceSchema", False)
                .option("multiLine", self.multi_line)
                .option("quote", '"')
                .option("escape", '"')
                .csv(path)
            )
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"No files for raw table '{self.name}' at {path}") from error
            raise


def _feed(prefix: str, pattern: str, labels: str = "") -> list[RawTable]:
    tables = {
        "orders": ORDERS, "order_items": ITEMS, "order_payments": PAYMENTS, "order_reviews": REVIEWS,
        "customers": CUSTOMERS,
    }
    return [
        RawTable(prefix + name, pattern.format(name=name), f"{columns} {labels}".strip(), "csv", name == "order_reviews")
        for name, columns in tables.items()
    ]


RAW_TABLES = {
    table.name: table
    for table in [
        *_feed("", "*/*_{name}_dataset.csv"),
        RawTable("sellers", "*/*_sellers_dataset.csv", SELLERS),
        RawTable("products", "*/*_products_dataset.csv", PRODUCTS),
        RawTable("geolocation", "*/*_geolocation_dataset.csv", GEOLOCATION),
        RawTable("category_translation", "*/product_category_name_translation.csv", CATEGORIES),
        RawTable("holidays", "holidays/holidays_BR_*.ndjson", HOLIDAYS, "ndjson"),
        RawTable("weather_daily", "weather/weather_*.ndjson", WEATHER, "ndjson"),
        RawTable("fx_rates", "fx/fx_EUR_BRL.ndjson", RATES, "ndjson"),
        RawTable("inflation_monthly", "ipca/ipca_BR.ndjson", INFLATION, "ndjson"),
        # SYNTHETIC DATA
        *_feed("sim_", "sim/sim_{name}.csv", LABELS),
    ]
}


def load_raw(spark: SparkSession, root: str, name: str) -> DataFrame:
    return RAW_TABLES[name].read(spark, root)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table, from one aggregate per table."""
    from promiselens.plans.profile import table_rows

    return table_rows(tables, {name for name in tables if name.startswith("sim_")})


def column_types(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) from the schemas; no data is read."""
    return [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files a path names; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")
    )


def missing_files(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    wanted = spark.createDataFrame([(name,) for name in expected], "file string")
    return wanted.join(files(spark, path).select("file"), "file", "left_anti")


def missing_tables(spark: SparkSession, root: str) -> DataFrame:
    """(table, pattern) of the raw tables without any file below ``root``; files are listed once and not opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    # A landed file may be a folder of parts.
    match = None
    for name, table in RAW_TABLES.items():
        shape = re.escape(table.pattern).replace(r"\*", "[^/]*")
        here = F.col("path").rlike(f"/{shape}(/[^/]*)?$")
        match = F.when(here, name) if match is None else match.when(here, name)
    found = listed.select(match.alias("table")).distinct()
    expected = spark.createDataFrame([(name, table.pattern) for name, table in RAW_TABLES.items()], "table string, pattern string")
    return expected.join(found, "table", "left_anti")


REJECTED, FILE, BLOCK = "_rejected", "_file", "_block"


def load_checked(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All records of a raw table, parsed once and stored with their file, the block of it, and the text of those that do not parse.

    Stored, because a record is known to be broken only when all its columns are parsed. ``accepted``, ``rejects`` and
    ``landing_report`` read the copy.
    """
    read = RAW_TABLES[name].read(spark, root, REJECTED)
    place = {FILE: F.col("_metadata.file_path"), BLOCK: F.col("_metadata.file_block_start")}
    return materialise(read.withColumns(place))


def accepted(checked: DataFrame) -> DataFrame:
    """The records that parse, in the shape of ``load_raw``."""
    return checked.where(F.col(REJECTED).isNull()).drop(REJECTED, FILE, BLOCK)


def rejects(checked: DataFrame, name: str) -> DataFrame:
    """(table, file, block, record): where every record that does not parse lies, and its text."""
    broken = checked.where(F.col(REJECTED).isNotNull())
    return broken.select(F.lit(name).alias("table"), F.col(FILE).alias("file"), F.col(BLOCK).alias("block"), F.col(REJECTED).alias("record"))


def landing_report(checked: DataFrame, name: str) -> DataFrame:
    """(table, file, records, loaded, rejected) of each landed file of a table; records = loaded + rejected."""
    bad = F.col(REJECTED).isNotNull()
    counts = checked.groupBy(F.col(FILE).alias("file")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("rejected")
    )
    return counts.select(F.lit(name).alias("table"), "file", "records", "loaded", "rejected")


def manifest(spark: SparkSession, root: str, table: RawTable) -> DataFrame:
    """(file, bytes, sha256, rows) per file, of any size. Rows are parsed records, not lines."""
    last = F.element_at(F.split("path", "/"), -1).alias("file")
    found = digests(spark, f"{root}/{table.pattern}").select(last, "bytes", "sha256")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    records = table.read(spark, root).groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return found.join(records, "file", "left").select("file", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"))


def reconcile_rows(source: DataFrame, loaded: DataFrame, table: str) -> int:
    """Row count of both sides; raises when a load lost or repeated rows."""
    expected, actual = source.count(), loaded.count()
    if expected != actual:
        raise ValueError(f"{table}: {expected} records in the source, {actual} rows loaded")
    return actual
