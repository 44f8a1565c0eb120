"""Landed files made of a feed: the text shapes that staging reads, both feeds, blanks and line breaks included."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.sources import registry, sinks

# Fixed value: the file name of a historical table.
HISTORICAL = "shop/x_{name}_dataset.csv"
LABELS = ["data_source", "is_synthetic", "sim_as_of"]
FOLDER = "landing"


def _raw(df: DataFrame, columns: str, values: dict[str, str | Column]) -> DataFrame:
    """``values`` in the order of the raw columns; a column without a value is blank."""
    named = [values.get(name, F.lit(None).cast("string")) for name in columns.split()]
    return df.select(
        *[(F.col(v) if isinstance(v, str) else v).alias(name) for v, name in zip(named, columns.split())],
        *[c for c in LABELS if c in df.columns],
    )


def _labelled(feed, df: DataFrame) -> DataFrame:
    """Labels of the order a row belongs to."""
    return df.join(feed.orders.select("order_id", *LABELS), "order_id")


def _land_both(feed, root: str, name: str, raw: DataFrame) -> None:
    """Historical rows without labels in the shop's file, the others with labels in the simulated one."""
    past = raw.where("not is_synthetic").drop(*LABELS)
    sinks.write_csv_text(past, f"{root}/{HISTORICAL.format(name=name)}")
    sinks.write_csv_text(raw.where("is_synthetic"), f"{root}/sim/sim_{name}.csv")


def land_orders(feed, root: str) -> None:
    typed = ["order_id", "customer_id", "order_status", "purchased_at", "approved_at", "shipped_at", "delivered_at"]
    names = registry.ORDERS.split()
    values: dict = dict(zip(names, typed)) | {names[-1]: F.col("promised_date").cast("timestamp_ntz")}
    _land_both(feed, root, "orders", _raw(feed.orders, registry.ORDERS, values))


def land_items(feed, root: str) -> None:
    values: dict = dict(zip(registry.ITEMS.split(), feed.items.columns))
    _land_both(feed, root, "order_items", _raw(_labelled(feed, feed.items), registry.ITEMS, values))


def land_payments(feed, root: str) -> None:
    values: dict = dict(zip(registry.PAYMENTS.split(), feed.payments.columns))
    _land_both(feed, root, "order_payments", _raw(_labelled(feed, feed.payments), registry.PAYMENTS, values))


def land_reviews(feed, root: str) -> None:
    """Comments hold quotes, commas and a line break; a missing comment is white space."""
    comment = F.when(F.col("has_comment"), F.lit('late,\n"again"')).otherwise(F.lit("  "))
    values = {
        "review_id": "review_id", "order_id": "order_id", "review_score": "review_score",
        "review_comment_message": comment, "review_creation_date": F.col("review_sent_date").cast("timestamp_ntz"),
        "review_answer_timestamp": "review_answered_at",
    }
    _land_both(feed, root, "order_reviews", _raw(_labelled(feed, feed.reviews), registry.REVIEWS, values))


def land_customers(feed, root: str) -> None:
    """Customers belong to a feed by their number; states are landed in lower case."""
    synthetic = F.col("customer_id") % 10 == 9
    labelled = feed.customers.withColumns(
        {
            "data_source": F.when(synthetic, feed.params.synthetic_source).otherwise(feed.params.historical_source),
            "is_synthetic": synthetic,
            "sim_as_of": F.expr("timestamp_ntz'2001-06-01 02:00:00'"),
        }
    )
    values = {
        "customer_id": "customer_id", "customer_unique_id": "customer_unique_id",
        "customer_zip_code_prefix": "customer_zip_prefix", "customer_city": "customer_city",
        "customer_state": F.lower("customer_state"),
    }
    _land_both(feed, root, "customers", _raw(labelled, registry.CUSTOMERS, values))


def land_sellers(feed, root: str) -> None:
    values = {
        "seller_id": "seller_id", "seller_zip_code_prefix": "seller_zip_prefix", "seller_city": "seller_city",
        "seller_state": F.lower("seller_state"),
    }
    sinks.write_csv_text(_raw(feed.sellers, registry.SELLERS, values), f"{root}/{HISTORICAL.format(name='sellers')}")


def land_products(feed, root: str) -> None:
    values = {
        "product_id": "product_id", "product_category_name": "category_name_pt", "product_photos_qty": "photo_count",
        "product_weight_g": "weight_g", "product_length_cm": "length_cm", "product_height_cm": "height_cm",
        "product_width_cm": "width_cm",
    }
    sinks.write_csv_text(_raw(feed.products, registry.PRODUCTS, values), f"{root}/{HISTORICAL.format(name='products')}")


def land_geolocation(feed, root: str) -> None:
    values = {
        "geolocation_zip_code_prefix": "zip_prefix", "geolocation_lat": "latitude", "geolocation_lng": "longitude",
        "geolocation_city": F.lit("são paulo"), "geolocation_state": F.lit("sp"),
    }
    raw = _raw(feed.geolocation, registry.GEOLOCATION, values)
    sinks.write_csv_text(raw, f"{root}/{HISTORICAL.format(name='geolocation')}")


def land_categories(feed, root: str) -> None:
    values: dict = dict(zip(registry.CATEGORIES.split(), ["category_name_pt", "category_name_en"]))
    raw = _raw(feed.categories, registry.CATEGORIES, values)
    sinks.write_csv_text(raw, f"{root}/shop/product_category_name_translation.csv")


def land_rates(feed, root: str) -> None:
    """The wanted pair beside another one."""
    pairs = F.explode(F.array(F.lit("BRL"), F.lit("USD")))
    raw = feed.fx_rates.select(
        F.col("rate_date").cast("string").alias("date"), F.lit("EUR").alias("base"), pairs.alias("quote"),
        F.col("brl_per_eur").alias("rate"),
    )
    sinks.write_ndjson(raw, f"{root}/fx/fx_EUR_BRL.ndjson")


def land_inflation(feed, root: str) -> None:
    raw = feed.inflation.select(F.date_format("month_start", "yyyy-MM").alias("month"), "pct_change")
    sinks.write_ndjson(raw, f"{root}/ipca/ipca_BR.ndjson")


def land_weather(feed, root: str) -> None:
    raw = feed.weather.select(
        "state_code", F.col("weather_date").cast("string").alias("time"),
        F.col("precipitation_mm").alias("precipitation_sum"),
        (F.col("precipitation_mm") + 20.0).alias("temperature_2m_max"),
        (F.col("precipitation_mm") + 10.0).alias("temperature_2m_min"),
    )
    sinks.write_ndjson(raw, f"{root}/weather/weather_BR.ndjson")


LAND = {
    "orders": land_orders, "items": land_items, "payments": land_payments, "reviews": land_reviews,
    "customers": land_customers, "sellers": land_sellers, "products": land_products, "geolocation": land_geolocation,
    "categories": land_categories, "fx_rates": land_rates, "inflation": land_inflation, "weather": land_weather,
}


def land_all(feed, root: str) -> str:
    """Land every table of the feed below a new folder, then commit it: a rerun replaces the files of the run before as a whole.

    Returns the folder. A run that stops leaves the last finished one current.
    """
    version = f"v-{uuid.uuid4().hex[:12]}"
    folder = f"{root}/{FOLDER}/{version}"
    for land in LAND.values():
        land(feed, folder)
    sinks.commit(feed.spark, root, {FOLDER: version})
    return folder


def current(spark: SparkSession, root: str) -> str:
    """The folder of the last finished run below ``root``."""
    version = sinks.latest_generation(spark, root)[1].get(FOLDER)
    if version is None:
        raise FileNotFoundError(f"{root} has no finished landing")
    return f"{root}/{FOLDER}/{version}"


# The raw tables that LAND leaves files of.
LANDED = [name for name in registry.RAW_TABLES if name != "holidays"]


def spoil(spark: SparkSession, root: str, name: str) -> None:
    """Beside the landed records of a raw table, as many that do not parse: a field too many, or JSON that breaks off."""
    table = registry.RAW_TABLES[name]
    path = f"{root}/" + table.pattern.replace("*/", "shop/").replace("/*_", "/x_").replace("*", "BR")
    raw = table.read(spark, root)
    first, *others = raw.columns
    if table.file_format == "ndjson":
        raw.select(F.concat(F.lit('{"'), F.lit(first), F.lit('": "'), F.coalesce(first, F.lit("")))).write.mode("append").text(path)
        return
    values = [F.lit(None).cast("string").alias(c) for c in others[:-1]] + [F.lit("one,too many").alias(c) for c in others[-1:]]
    raw.select(F.col(first), *values).write.mode("append").option("header", True).option("quote", "").csv(path)
