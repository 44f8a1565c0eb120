"""The full refresh: facts written once, everything else computed from the written facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.operators.passes import in_passes, pass_count
from promiselens.params import Params
from promiselens.plans import facts, marts, verify
from promiselens.session import KEPT_CODEC, shuffles_dropped
from promiselens.sources import sinks

TABLES = [
    "fct_orders", "fct_order_items", "dim_date", "dim_sellers", "dim_products", "dim_states", "mart_monthly_kpis",
    "mart_route_performance", "mart_seller_performance", "mart_late_drivers", "mart_live_daily",
]


def build(feed, params: Params, root: str) -> dict[str, DataFrame]:
    """Writes the star schema and the result tables below ``root`` and returns them as read back.

    Every table is a new version in its folder. One commit at the end, after the second-path verification of the order fact,
    makes all of them the current generation: a wrong number or a stop at any moment leaves all tables of the run before,
    and a run that was overtaken by another one fails instead of replacing it. The order fact is partitioned by purchase month.
    Facts of large sources are written in passes by order, so the shuffles of one pass are on disk beside what is written.
    """
    spark = feed.spark
    started_on, _ = sinks.latest_generation(spark, root)
    month = F.date_format("purchase_date", "yyyy-MM")
    versions: dict[str, str] = {}

    def write(name: str, df: DataFrame, partition_by: str | None = None, by_order: bool = False) -> DataFrame:
        parts = in_passes(df, ["order_id"], pass_count(df, params) if by_order else 1)
        # Rebalancing gathers a month's rows into few files and still splits a month that is too large.
        shaped = [part.hint("rebalance", partition_by) for part in parts] if partition_by else parts
        versions[name] = sinks.write_version(shaped, f"{root}/{name}", partition_by, KEPT_CODEC)
        return sinks.read_version(spark, f"{root}/{name}", versions[name])

    orders = write("fct_orders", facts.order_facts(feed, params).withColumn("purchase_month", month), "purchase_month", by_order=True)
    with shuffles_dropped(spark):
        failed = verify.compare_metrics(verify.recomputed(feed, params), verify.from_facts(months(orders, params.kpi_start, params.kpi_end))).where("not match")
        wrong = failed.collect()  # at most one row per metric
    if wrong:
        raise ValueError(f"Facts differ from the second path: {wrong}")
    in_window = months(orders, params.kpi_start, params.kpi_end)
    items = write("fct_order_items", facts.item_facts(feed, params, orders), by_order=True)
    results = {
        "dim_date": facts.date_dimension(feed, params),
        "dim_sellers": facts.seller_dimension(feed, params),
        "dim_products": facts.product_dimension(feed, params),
        "dim_states": feed.states,
        "mart_monthly_kpis": marts.monthly_kpis(in_window),
        "mart_route_performance": marts.route_performance(in_window, params),
        "mart_seller_performance": marts.seller_performance(items, params),
        "mart_late_drivers": marts.late_drivers(in_window, params),
        "mart_live_daily": marts.live_daily(orders),
    }
    tables = {"fct_orders": orders, "fct_order_items": items, **{name: write(name, df) for name, df in results.items()}}
    sinks.commit(spark, root, versions, based_on=started_on)
    return tables


def months(orders: DataFrame, first: date, last: date) -> DataFrame:
    """Written order facts of the months that hold the days first..last: other months' files are not opened.

    Callers keep their own filter on days; this one only lets the scan skip partitions.
    """
    return orders.where(F.col("purchase_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that the last finished run left below ``root``, all of one generation."""
    return sinks.read_generation(spark, root)


def export(tables: dict[str, DataFrame], root: str) -> None:
    """The written tables for dashboards: exact decimals as doubles."""
    sinks.export_parquet(tables, root)
