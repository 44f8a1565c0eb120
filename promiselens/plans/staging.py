"""Raw text -> typed model tables. Nothing is removed; each feed has one function for both origins."""

from __future__ import annotations

from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.functions import geo
from promiselens.functions.text import blank_to_null, contains
from promiselens.params import Params
from promiselens.sources import fixed_values, sinks
from promiselens.sources.registry import load_raw

MONEY = "decimal(28,6)"
TIMESTAMP = "timestamp_ntz"


def _as(column: str, kind: str, name: str | None = None) -> Column:
    return blank_to_null(column).cast(kind).alias(name or column)


def _day(column: str, name: str) -> Column:
    return blank_to_null(column).cast(TIMESTAMP).cast("date").alias(name)


def _labels(raw: DataFrame, params: Params) -> list[Column]:
    """Provenance: read from a synthetic file, constant for the historical one."""
    if "data_source" in raw.columns:
        return [F.col("data_source"), _as("is_synthetic", "boolean"), _as("sim_as_of", TIMESTAMP)]
    return [
        F.lit(params.historical_source).alias("data_source"),
        F.lit(False).alias("is_synthetic"),
        F.lit(None).cast(TIMESTAMP).alias("sim_as_of"),
    ]


def orders(raw: DataFrame, params: Params) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        "order_status",
        _as("order_purchase_timestamp", TIMESTAMP, "purchased_at"),
        _as("order_approved_at", TIMESTAMP, "approved_at"),
        _as("order_delivered_carrier_date", TIMESTAMP, "shipped_at"),
        _as("order_delivered_customer_date", TIMESTAMP, "delivered_at"),
        _day("order_estimated_delivery_date", "promised_date"),
        *_labels(raw, params),
    )


def items(raw: DataFrame, params: Params) -> DataFrame:
    return raw.select(
        "order_id",
        _as("order_item_id", "int", "order_item_number"),
        "product_id",
        "seller_id",
        _as("shipping_limit_date", TIMESTAMP, "shipping_limit_at"),
        _as("price", MONEY, "price_brl"),
        _as("freight_value", MONEY, "freight_brl"),
        *_labels(raw, params),
    )


def payments(raw: DataFrame, params: Params) -> DataFrame:
    return raw.select(
        "order_id",
        _as("payment_sequential", "int", "payment_sequence"),
        "payment_type",
        _as("payment_installments", "int", "installments"),
        _as("payment_value", MONEY, "payment_brl"),
        *_labels(raw, params),
    )


def reviews(raw: DataFrame, params: Params) -> DataFrame:
    return raw.select(
        "review_id",
        "order_id",
        _as("review_score", "int"),
        F.coalesce(F.trim("review_comment_message") != "", F.lit(False)).alias("has_comment"),
        _day("review_creation_date", "review_sent_date"),
        _as("review_answer_timestamp", TIMESTAMP, "review_answered_at"),
        *_labels(raw, params),
    )


def customers(raw: DataFrame, params: Params) -> DataFrame:
    return raw.select(
        "customer_id",
        "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("customer_zip_prefix"),
        "customer_city",
        F.upper("customer_state").alias("customer_state"),
        *_labels(raw, params),
    )


def sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("seller_zip_prefix"),
        "seller_city",
        F.upper("seller_state").alias("seller_state"),
    )


def products(raw: DataFrame) -> DataFrame:
    return raw.select(
        "product_id",
        blank_to_null("product_category_name").alias("category_name_pt"),
        _as("product_photos_qty", "int", "photo_count"),
        _as("product_name_lenght", "int", "name_length"),
        _as("product_description_lenght", "int", "description_length"),
        _as("product_weight_g", "double", "weight_g"),
        *[_as(f"product_{side}_cm", "double", f"{side}_cm") for side in ("length", "height", "width")],
    )


def geolocation(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("geolocation_zip_code_prefix").alias("zip_prefix"),
        _as("geolocation_lat", "double", "latitude"),
        _as("geolocation_lng", "double", "longitude"),
        F.col("geolocation_city").alias("city"),
        F.upper("geolocation_state").alias("state_code"),
    ).withColumn("is_inside_brazil", geo.is_inside_market())


def categories(raw: DataFrame, additions: DataFrame) -> DataFrame:
    translated = raw.select(
        F.col("product_category_name").alias("category_name_pt"),
        F.col("product_category_name_english").alias("category_name_en"),
    )
    return translated.unionByName(additions)


def fx_rates(raw: DataFrame, base: str = "EUR", quote: str = "BRL") -> DataFrame:
    return raw.where((F.col("base") == base) & (F.col("quote") == quote)).select(
        F.col("date").cast("date").alias("rate_date"), F.col("rate").cast("double").alias("brl_per_eur")
    )


def holidays(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("date").cast("date").alias("holiday_date"),
        F.col("name").alias("holiday_name"),
        F.col("localName").alias("holiday_name_local"),
        F.col("global").alias("is_nationwide"),
        F.col("counties").alias("state_iso_codes"),
        contains("types", "Public").alias("is_public_holiday"),
        contains("types", "Bank").alias("is_bank_holiday"),
    )


def inflation(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.to_date(F.concat("month", F.lit("-01"))).alias("month_start"), F.col("pct_change").cast("double")
    )


def weather(raw: DataFrame) -> DataFrame:
    return raw.select(
        "state_code",
        F.col("time").cast("date").alias("weather_date"),
        F.col("precipitation_sum").cast("double").alias("precipitation_mm"),
        F.col("temperature_2m_max").cast("double").alias("temperature_max_c"),
        F.col("temperature_2m_min").cast("double").alias("temperature_min_c"),
    )


class LandedFeed:
    """The model tables over a landing folder: both feeds unioned, reference tables typed."""

    def __init__(self, spark: SparkSession, root: str, params: Params = Params(), with_synthetic: bool = True):
        self.spark, self.root, self.params, self.with_synthetic = spark, root, params, with_synthetic

    def raw(self, name: str) -> DataFrame:
        return load_raw(self.spark, self.root, name)

    def _both(self, stage, name: str) -> DataFrame:
        historical = stage(self.raw(name), self.params)
        if not self.with_synthetic:
            return historical
        return historical.unionByName(stage(self.raw(f"sim_{name}"), self.params))

    @cached_property
    def orders(self) -> DataFrame:
        return self._both(orders, "orders")

    @cached_property
    def items(self) -> DataFrame:
        # The item's own labels repeat the order's; the facts take them from the order.
        return self._both(items, "order_items").drop("data_source", "is_synthetic", "sim_as_of")

    @cached_property
    def payments(self) -> DataFrame:
        return self._both(payments, "order_payments").drop("data_source", "is_synthetic", "sim_as_of")

    @cached_property
    def reviews(self) -> DataFrame:
        return self._both(reviews, "order_reviews").drop("data_source", "is_synthetic", "sim_as_of")

    @cached_property
    def customers(self) -> DataFrame:
        return self._both(customers, "customers").drop("data_source", "is_synthetic", "sim_as_of")

    @cached_property
    def sellers(self) -> DataFrame:
        return sellers(self.raw("sellers"))

    @cached_property
    def products(self) -> DataFrame:
        return products(self.raw("products"))

    @cached_property
    def geolocation(self) -> DataFrame:
        return geolocation(self.raw("geolocation"))

    @cached_property
    def categories(self) -> DataFrame:
        return categories(self.raw("category_translation"), fixed_values.extra_categories(self.spark))

    @cached_property
    def states(self) -> DataFrame:
        return fixed_values.states(self.spark)

    @cached_property
    def fx_rates(self) -> DataFrame:
        return fx_rates(self.raw("fx_rates"))

    @cached_property
    def holidays(self) -> DataFrame:
        return holidays(self.raw("holidays"))

    @cached_property
    def inflation(self) -> DataFrame:
        return inflation(self.raw("inflation_monthly"))

    @cached_property
    def weather(self) -> DataFrame:
        return weather(self.raw("weather_daily"))


MODEL_TABLES = [
    "orders", "items", "payments", "reviews", "customers", "sellers", "products", "geolocation", "categories",
    "states", "fx_rates", "holidays", "inflation", "weather",
]


# Joined with each other by order in nearly every query.
BY_ORDER = {"orders": "customer_id", "items": "order_item_number", "payments": "payment_sequence", "reviews": "review_id"}


def order_rows(df: DataFrame, spread_by: str, params: Params) -> tuple[int, int]:
    """(rows of the table, rows of its largest order or of those without one), both by a hash sample of the rows."""
    one_in = params.hot_key_sample
    sampled = df.where(F.pmod(F.xxhash64("order_id", spread_by), F.lit(one_in)) == 0)
    counted = sampled.groupBy("order_id").agg(F.count(F.lit(1)).alias("rows"))
    rows, most = counted.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    return rows * one_in, most * one_in


def order_buckets(feed, rows: dict[str, int]) -> int:
    """Buckets of the tables that are kept by order: by the largest one's rows and types, never fewer than there are cores.

    Catalyst's size estimate does not serve here: it multiplies the sides of a join, and items look their order up.
    """
    largest = max(n * getattr(feed, name)._jdf.schema().defaultSize() for name, n in rows.items())
    return min(max(-(-largest // feed.params.bucket_bytes), feed.spark.sparkContext.defaultParallelism), feed.params.max_buckets)


def store(feed, root: str) -> SimpleNamespace:
    """Writes the typed tables as Parquet once and returns a feed that reads them.

    Text files are parsed once, not once per query; the copies are columnar and have true sizes. Orders, items,
    payments and reviews lie in equal buckets by order, so the facts group and join them without a shuffle. A table with a hot order is
    written without buckets and stays splittable: its joins shuffle, and adaptive execution splits them.
    All tables are written, then committed together, so a failing write leaves the typed tables of the run before.
    """
    found = {name: order_rows(getattr(feed, name), spread_by, feed.params) for name, spread_by in BY_ORDER.items()}
    one_in = feed.params.hot_key_sample
    hot_from = max(feed.params.hot_key_rows // one_in, 1) * one_in
    buckets, versions = order_buckets(feed, {name: rows for name, (rows, _) in found.items()}), {}
    for name in MODEL_TABLES:
        table, folder = getattr(feed, name), f"{root}/{name}"
        if name in BY_ORDER and found[name][1] < hot_from:
            versions[name] = sinks.write_bucketed(table, folder, "order_id", buckets)
        else:
            versions[name] = sinks.write_version(table, folder)
    sinks.commit(feed.spark, root, versions)
    return stored(feed.spark, root, feed.params)


def stored(spark: SparkSession, root: str, params: Params) -> SimpleNamespace:
    """The typed tables of the last commit below ``root``, all of one generation."""
    return SimpleNamespace(spark=spark, params=params, **sinks.read_generation(spark, root))
