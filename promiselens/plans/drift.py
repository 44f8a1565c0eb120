"""Does the synthetic feed still look like the historical one? 14 measures with tolerances.

One pass over the fact gives the scalar measures of both feeds; one pass gives the counts behind the
share comparisons. Both results are a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.functions import dates, rules
from promiselens.functions.stats import avg_where, safe_ratio
from promiselens.params import Params

NEEDS = ["purchase_date", "purchased_at", "is_synthetic", "is_in_kpi_window", "is_delivered", "is_late",
         "delivery_outcome", "main_payment_type", "customer_region", "promised_days", "actual_days",
         "seller_missed_ship_by", "review_score", "approval_hours", "gmv_brl"]

# Fixed values, in report order: measure, how it is taken, allowed difference. A gap names its share table; a relative
# difference is a share of the historical value.
MEASURES = [
    ("Weekday pattern: largest gap in share of orders", "gap weekday", 0.015),
    ("Hour of day: largest gap in share of orders", "gap hour", 0.01),
    ("Payment mix: largest gap in share", "gap payment", 0.015),
    ("Share of orders delivered", "absolute", 0.005),
    ("Average promised days (delivered orders)", "absolute", 1.0),
    ("Average actual delivery days", "absolute", 1.0),
    ("Late rate (delivered orders)", "absolute", 0.015),
    ("Late rate by region: largest gap", "gap region", 0.03),
    ("Seller missed hand-over deadline", "absolute", 0.02),
    ("1-2 star reviews, on-time orders", "absolute", 0.02),
    ("1-2 star reviews, late orders", "absolute", 0.05),
    ("Median approval hours, credit card", "absolute", 0.5),
    ("Median approval hours, boleto", "absolute", 6.0),
    ("Average order value, prices of the historical period (relative)", "relative", 0.03),
]
SCALARS = [m for m in MEASURES if not m[1].startswith("gap")]
GAPS = [(measure, kind.removeprefix("gap "), allowed) for measure, kind, allowed in MEASURES if kind.startswith("gap")]
COMPARED_PAYMENTS = ["credit_card", "boleto", "voucher", "debit_card"]


def _mean_of(condition: Column, flag: Column) -> Column:
    return avg_where(condition & flag.isNotNull(), flag.cast("int"))


def _scalars(orders: DataFrame, params: Params) -> DataFrame:
    real_all = F.col("is_in_kpi_window")
    normal = real_all & ~dates.year_month("purchase_date").isin(list(params.excluded_months))
    synthetic, delivered, late = F.col("is_synthetic"), F.col("is_delivered"), F.col("is_late")
    outcome, score = F.col("delivery_outcome"), F.col("review_score")
    low = score <= params.low_review_max
    arrived = outcome.isin(rules.ON_TIME, rules.LATE, rules.DATE_MISSING)
    payment = F.col("main_payment_type")

    def both(real: Column, simulated: Column) -> Column:
        return F.struct(real.cast("double").alias("real"), simulated.cast("double").alias("simulated"))

    def median(who: Column, kind: str) -> Column:
        return F.median(F.when(who & (payment == kind), F.col("approval_hours")))

    pairs = [
        both(_mean_of(real_all, arrived), _mean_of(synthetic & (outcome != rules.OPEN), delivered)),
        both(avg_where(normal & delivered, "promised_days"), avg_where(synthetic & delivered, "promised_days")),
        both(avg_where(normal & delivered, "actual_days"), avg_where(synthetic & delivered, "actual_days")),
        both(_mean_of(normal & delivered, late), _mean_of(synthetic & delivered, late)),
        both(
            _mean_of(normal & delivered, F.col("seller_missed_ship_by")),
            _mean_of(synthetic & delivered, F.coalesce("seller_missed_ship_by", F.lit(False))),
        ),
        # The historical share counts unreviewed orders as not low; the synthetic one counts reviewed orders.
        both(
            _mean_of(real_all & (outcome == rules.ON_TIME), F.coalesce(low, F.lit(False))),
            _mean_of(synthetic & delivered & ~late, low),
        ),
        both(
            _mean_of(real_all & (outcome == rules.LATE), F.coalesce(low, F.lit(False))),
            _mean_of(synthetic & late, low),
        ),
        both(median(real_all, "credit_card"), median(synthetic, "credit_card")),
        both(median(real_all, "boleto"), median(synthetic, "boleto")),
        both(avg_where(real_all & delivered, "gmv_brl"), avg_where(synthetic, F.col("gmv_brl") / F.col("price_factor"))),
    ]
    row = orders.agg(*[pair.alias(f"_{i}") for i, pair in enumerate(pairs)])
    lines = [
        F.struct(
            F.lit(measure).alias("measure"),
            F.col(f"_{i}.real").alias("real"),
            F.col(f"_{i}.simulated").alias("simulated"),
            F.lit(tolerance).alias("allowed"),
            F.lit(kind == "relative").alias("is_relative"),
        )
        for i, (measure, kind, tolerance) in enumerate(SCALARS)
    ]
    return row.select(F.inline(F.array(*lines)))


def share_vectors(orders: DataFrame, params: Params) -> DataFrame:
    """(kind, key, real, simulated): share of orders per weekday, hour and payment type; late rate per region."""
    real_all, synthetic, delivered = F.col("is_in_kpi_window"), F.col("is_synthetic"), F.col("is_delivered")
    normal = real_all & ~dates.year_month("purchase_date").isin(list(params.excluded_months))
    level = F.col("purchase_date").between(F.lit(params.level_start), F.lit(params.level_end))
    nothing = F.lit(None).cast("boolean")

    def line(kind: str, key: Column, in_real: Column, in_sim: Column, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), key.cast("string").alias("key"), in_real.alias("in_real"),
            in_sim.alias("in_sim"), value.alias("value"),
        )

    lines = F.array(
        line("weekday", dates.iso_weekday("purchase_date"), level, synthetic, nothing),
        line("hour", F.hour("purchased_at"), real_all, synthetic, nothing),
        line("payment", F.col("main_payment_type"), real_all & delivered, synthetic, nothing),
        line("region", F.col("customer_region"), normal & delivered, synthetic & delivered, F.col("is_late")),
    )
    known = orders.select(F.inline(lines)).where("key is not null and (in_real or in_sim)")
    counted = known.groupBy("kind", "key").agg(
        F.count_if("in_real").alias("_real"),
        F.count_if("in_sim").alias("_sim"),
        F.avg(F.when(F.col("in_real"), F.col("value").cast("int"))).alias("_real_rate"),
        F.avg(F.when(F.col("in_sim"), F.col("value").cast("int"))).alias("_sim_rate"),
    )
    kind = Window.partitionBy("kind")  # over the counts: at most a few dozen rows
    is_rate = F.col("kind") == "region"
    return counted.select(
        "kind",
        "key",
        F.when(is_rate, F.col("_real_rate")).otherwise(safe_ratio("_real", F.sum("_real").over(kind))).alias("real"),
        F.when(is_rate, F.col("_sim_rate")).otherwise(safe_ratio("_sim", F.sum("_sim").over(kind))).alias("simulated"),
    )


def largest_gaps(vectors: DataFrame) -> DataFrame:
    """Largest absolute gap per kind. A missing share is 0; a missing rate is not compared."""
    compared = vectors.where((F.col("kind") != "payment") | F.col("key").isin(COMPARED_PAYMENTS))
    return compared.groupBy("kind").agg(F.max(F.abs(F.col("simulated") - F.col("real"))).alias("gap"))


def drift_report(orders: DataFrame, factors: DataFrame, params: Params) -> DataFrame:
    """``factors``: price factor per month, one row a month. Orders still in transit are not judged as undelivered."""
    month = dates.month_start("purchase_date")
    orders = orders.withColumn("month_start", month).join(F.broadcast(factors), "month_start", "left")
    labels = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.lit(k).alias("kind"), F.lit(t).alias("allowed"))
            for m, k, t in GAPS
        ]
    )
    gaps = (
        orders.sparkSession.range(1)
        .select(F.inline(labels))
        .join(largest_gaps(share_vectors(orders, params)), "kind", "left")
        .select(
            "measure", F.lit(0.0).alias("real"), F.col("gap").alias("simulated"), "allowed",
            F.lit(False).alias("is_relative"),
        )
    )
    gap = F.col("simulated") - F.col("real")
    difference = F.when(F.col("is_relative"), gap / F.nullif(F.col("real"), F.lit(0.0))).otherwise(gap)
    return (
        gaps.unionByName(_scalars(orders, params))
        .withColumn("difference", difference)
        .withColumn("within", F.coalesce(F.abs("difference") <= F.col("allowed"), F.lit(False)))
    )
