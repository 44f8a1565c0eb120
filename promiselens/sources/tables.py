"""The order model as views over the given test tables (orders, lineitem, customer, ...).

Every view is a projection of the tables (or a bounded aggregate by day and state), so the amount of
work grows with them. All rules live in ``plans``; nothing here is specific to a query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.functions import geo
from promiselens.operators.joins import lookup_join
from promiselens.params import TABLE_PARAMS, Params

SIM_AS_OF = "2001-06-01 02:00:00"

# Declared, so that no job is spent on reading file footers while a plan is built.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _plus_minutes(ts: str, minutes: str) -> Column:
    return F.expr(f"timestampadd(MINUTE, cast({minutes} as int), {ts})")


def _zip(key: str) -> Column:
    return F.lpad((F.expr(f"{key} % 500") * 197 % 100000).cast("string"), 5, "0")


def _iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


class TableFeed:
    """Typed model tables: the shape staging gives, with the test tables as the origin."""

    def __init__(self, spark: SparkSession, folder: str, params: Params = TABLE_PARAMS):
        self.spark, self.folder, self.params = spark, folder, params

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        start = "o_orderkey*37 % 1440"
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        synthetic = key % 10 == 9
        shipped = _plus_minutes("o_orderdate", f"{start} + (1 + o_orderkey % 9)*1440 - o_custkey % 3000")
        delivered = _plus_minutes("o_orderdate", f"{start} + (3 + (o_orderkey*7 + o_custkey) % 30)*1440")
        return self.table("orders").select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(status == "F", "delivered")
            .when(status == "O", "shipped")
            .when(key % 4 == 0, "canceled")
            .otherwise("processing")
            .alias("order_status"),
            _plus_minutes("o_orderdate", start).alias("purchased_at"),
            F.when(
                key % 97 != 0, _plus_minutes("o_orderdate", f"{start} + o_custkey*13 % 4000")
            ).alias("approved_at"),
            F.when(status != "P", shipped).alias("shipped_at"),
            F.when((status == "F") & (key % 50 != 0), delivered).alias("delivered_at"),
            F.date_add(F.col("o_orderdate").cast("date"), (10 + key % 21).cast("int")).alias("promised_date"),
            F.when(synthetic, self.params.synthetic_source)
            .otherwise(self.params.historical_source)
            .alias("data_source"),
            synthetic.alias("is_synthetic"),
            F.when(synthetic, F.expr(f"timestamp_ntz'{SIM_AS_OF}'")).alias("sim_as_of"),
        )

    @cached_property
    def items(self) -> DataFrame:
        # A deadline counts from the order date, so the order is looked up; lineitem is the large side.
        dated = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
        lines = self.table("lineitem")
        spread = ["l_linenumber", "l_partkey"]
        return lookup_join(lines, dated, ["l_orderkey"], self.params, "inner", lines, spread).select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_number"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            _plus_minutes("o_orderdate", "(2 + l_suppkey % 6)*1440").alias("shipping_limit_at"),
            F.col("l_extendedprice").cast("decimal(28,6)").alias("price_brl"),
            F.expr(
                "cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(28,6))"
            ).alias("freight_brl"),
        )

    @cached_property
    def item_keys(self) -> DataFrame:
        """The keys of the items, without the look-up of their orders."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_number"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequence"),
            F.when(flag == "R", "boleto").when(flag == "A", "credit_card").otherwise("voucher").alias("payment_type"),
            (1 + F.col("l_quantity") % 12).cast("int").alias("installments"),
            F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).cast("decimal(28,6)").alias("payment_brl"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        event = F.col("event_id")
        answered = F.expr("ts - interval 24 years")
        return self.table("events").select(
            event.alias("review_id"),
            (event - event % 3).alias("order_id"),
            (1 + event % 5).cast("int").alias("review_score"),
            (F.col("value") > 50).alias("has_comment"),
            answered.cast("date").alias("review_sent_date"),
            F.when(event % 11 != 0, answered).alias("review_answered_at"),  # some were never answered
        )

    @cached_property
    def states(self) -> DataFrame:
        return self.table("nation").join(
            F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(F.col("n_name").alias("state_code"), F.col("r_name").alias("region"))

    def _state(self, nation_key: Column) -> Column:
        """Name of a nation. There are 25 nations at any scale: one map from a scalar subquery, no join."""
        entries = F.array_agg(F.struct("n_nationkey", "n_name"))
        return F.element_at(self.table("nation").agg(F.map_from_entries(entries)).scalar(), nation_key)

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.floor(F.col("c_custkey") / 2).cast("long").alias("customer_unique_id"),
            _zip("c_custkey").alias("customer_zip_prefix"),
            F.col("c_name").alias("customer_city"),
            self._state(F.col("c_nationkey")).alias("customer_state"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_name").alias("seller_city"),
            _zip("s_suppkey").alias("seller_zip_prefix"),
            self._state(F.col("s_nationkey")).alias("seller_state"),
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        def points(table: str, key: str, north: int, east: int) -> DataFrame:
            return self.table(table).select(
                _zip(key).alias("zip_prefix"),
                (F.lit(-34.5) + (F.col(key) * north % 400) / 10.0).alias("latitude"),
                (F.lit(-74.5) + (F.col(key) * east % 400) / 10.0).alias("longitude"),
            )

        both = points("customer", "c_custkey", 41, 29).unionByName(points("supplier", "s_suppkey", 37, 53))
        return both.withColumn("is_inside_brazil", geo.is_inside_market())

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("product_id"),
            F.when(key % 20 != 0, F.col("p_type")).alias("category_name_pt"),
            (F.col("p_size") % 6).cast("int").alias("photo_count"),
            F.when(key % 33 != 0, F.col("p_size") * 250.0).alias("weight_g"),
            F.col("p_size").cast("double").alias("length_cm"),
            (key % 40 + 1).cast("double").alias("height_cm"),
            (key % 25 + 1).cast("double").alias("width_cm"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        known = self.table("part").where("p_type <> 'PROMO'").select("p_type").distinct()
        return known.select(F.col("p_type").alias("category_name_pt"), F.lower("p_type").alias("category_name_en"))

    @cached_property
    def _order_days(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderdate").cast("date").alias("day"))

    @cached_property
    def fx_rates(self) -> DataFrame:
        weekday = _iso_weekday(F.col("day"))
        return self._order_days.distinct().where(weekday <= 5).select(
            F.col("day").alias("rate_date"),
            (F.lit(3.0) + (weekday + F.year("day") % 7) / 10.0).alias("brl_per_eur"),
        )

    @cached_property
    def inflation(self) -> DataFrame:
        months = self._order_days.select(F.trunc("day", "month").alias("month_start")).distinct()
        return months.select(
            "month_start",
            ((F.month("month_start") * 7 + F.year("month_start")) % 9 / 10.0 - 0.2).alias("pct_change"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        """A month's first day with an order of a priority is a holiday of this calendar, named by the priority.

        All orders are read; the records number at most five a month.
        """
        days = (
            self.table("orders")
            .groupBy(F.trunc("o_orderdate", "month").alias("_month"), F.col("o_orderpriority").alias("holiday_name"))
            .agg(F.min("o_orderdate").cast("date").alias("holiday_date"))
        )
        nationwide = F.col("holiday_name").isin("1-URGENT", "2-HIGH")
        length, day = F.length("holiday_name"), F.dayofmonth("holiday_date")
        codes = [
            F.concat(F.lit("BR-"), self._state((F.dayofyear("holiday_date") + shift) % 25)) for shift in (0, 7)
        ]
        return days.select(
            "holiday_date",
            "holiday_name",
            nationwide.alias("is_nationwide"),
            F.when(~nationwide, F.array(*codes)).alias("state_iso_codes"),
            ((length + day) % 3 != 0).alias("is_public_holiday"),
            ((length + day) % 2 == 0).alias("is_bank_holiday"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        placed = lookup_join(
            self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
            self.customers.select(F.col("customer_id").alias("o_custkey"), "customer_state"),
            ["o_custkey"],
            self.params,
            "inner",
            self.table("orders"),
            ["o_orderkey"],
        )
        return placed.groupBy(
            F.col("customer_state").alias("state_code"), F.col("o_orderdate").cast("date").alias("weather_date")
        ).agg((F.count(F.lit(1)) * 9).cast("double").alias("precipitation_mm"))

    @cached_property
    def planned_orders(self) -> DataFrame:
        """Orders with all events of their life, also those that end without delivery."""
        processing = F.col("order_status") == "processing"
        return self.orders.withColumns(
            {
                "canceled_at": F.when(
                    F.col("order_status") == "canceled", F.col("purchased_at") + F.expr("interval 1 day")
                ),
                "unavailable_at": F.when(
                    processing & (F.col("order_id") % 3 == 0), F.col("purchased_at") + F.expr("interval 2 days")
                ),
                "is_stuck": processing,
            }
        )

    @cached_property
    def weather_payload(self) -> DataFrame:
        """Per state the days and values as parallel arrays, as a weather service answers them.

        A state has at most one entry per calendar day.
        """
        day = F.struct(
            F.date_format("weather_date", "yyyy-MM-dd").alias("time"),
            F.when(F.dayofmonth("weather_date") != 31, F.col("precipitation_mm")).alias("precipitation_sum"),
            (F.col("precipitation_mm") + 20.0).alias("temperature_2m_max"),
            (F.col("precipitation_mm") + 10.0).alias("temperature_2m_min"),
        )
        names = ["time", "precipitation_sum", "temperature_2m_max", "temperature_2m_min"]
        days = self.weather.groupBy("state_code").agg(F.sort_array(F.collect_list(day)).alias("_days"))
        arrays = F.struct(*[F.col(f"_days.{name}").alias(name) for name in names])
        return days.select(
            "state_code",
            F.lit(-10.0).alias("latitude"),
            F.lit(-50.0).alias("longitude"),
            F.lit("UTC").alias("timezone"),
            arrays.alias("daily"),
        )

    @cached_property
    def rate_payload(self) -> DataFrame:
        """All days in one map, as a rate service answers them (at most one entry per calendar day)."""
        entry = F.struct(
            F.date_format("rate_date", "yyyy-MM-dd").alias("day"),
            F.create_map(F.lit("BRL"), F.col("brl_per_eur"), F.lit("USD"), F.lit(1.1)).alias("quotes"),
        )
        return self.fx_rates.agg(F.map_from_entries(F.collect_list(entry)).alias("rates")).select(
            F.lit(1.0).alias("amount"), F.lit("EUR").alias("base"), "rates"
        )

    @cached_property
    def inflation_text(self) -> DataFrame:
        """Dates as dd/MM/yyyy, numbers as text with a decimal comma."""
        return self.inflation.select(
            F.date_format("month_start", "dd/MM/yyyy").alias("data"),
            F.regexp_replace(F.format_number("pct_change", 1), "[.]", ",").alias("valor"),
        )

    @cached_property
    def inflation_coded(self) -> DataFrame:
        """Months as yyyyMM after a header row, as the backup service answers them."""
        header = self.inflation.groupBy().agg(F.lit("Month (code)").alias("D3C"), F.lit("Value").alias("V"))
        rows = self.inflation.select(
            F.date_format("month_start", "yyyyMM").alias("D3C"), F.format_number("pct_change", 1).alias("V")
        )
        return header.unionByName(rows)
