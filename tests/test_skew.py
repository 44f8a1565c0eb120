"""Joins and ranks that spread hot keys give the same rows as the plain operators."""

from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from promiselens.operators import joins, ranking
from promiselens.params import Params
from promiselens.session import ADAPTIVE_BROADCAST_THRESHOLD, BROADCAST_THRESHOLD, apply_runtime_settings

TINY = replace(Params(), broadcast_limit_bytes=0, hot_key_rows=4, hot_key_sample=2, salts=5)


@pytest.fixture(scope="module")
def fact(spark):
    # A third of the rows share key 0, another part has no key.
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 50)
    return spark.range(900).select("id", key.cast("long").alias("k"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_plain_join(spark, fact, how):
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert joins.hot_keys(fact, ["k"], ["id"], TINY).where("k = 0").count() == 1
    spread = joins.lookup_join(fact, lookup, ["k"], TINY, how, fact, ["id"])
    plain = fact.join(lookup, ["k"], how)
    assert sorted(map(str, spread.select("id", "k", "v").collect())) == sorted(map(str, plain.select("id", "k", "v").collect()))


def test_hot_key_really_spreads(spark, fact):
    lookup = spark.range(40).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = joins.spread_join(fact, lookup, ["k"], ["id"], fact, TINY)._jdf.queryExecution().toString()
    assert "_salt" in plan
    salts = fact.where("k = 0").select(F.pmod(F.hash("id"), F.lit(TINY.salts))).distinct().count()
    assert salts == TINY.salts


def test_small_lookup_is_broadcast(spark, fact):
    lookup = spark.range(40).select(F.col("id").alias("k"))
    plan = joins.lookup_join(fact, lookup, ["k"], Params())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_lookup_that_is_small_in_its_file_only_is_not_broadcast(spark, tmp_path):
    """Ten bytes a row in the file, eighty in a broadcast: the rows decide, not the file."""
    spark.range(0, 200_000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/t")
    lookup = spark.read.schema("k long, v long").parquet(f"{tmp_path}/t")
    limits = replace(Params(), broadcast_limit_bytes=8 * 1024 * 1024)
    fact = spark.range(0, 400_000, 997).select("id", F.col("id").alias("k"))
    assert joins.estimated_bytes(lookup) < limits.broadcast_limit_bytes < joins.held_bytes(lookup)
    for how, rows in (("left", 402), ("inner", 201)):
        joined = joins.lookup_join(fact, lookup, ["k"], limits, how, fact, ["id"])
        plan = joined._jdf.queryExecution().toString()
        assert "ResolvedHint" not in plan and "broadcast" not in plan.split("== Physical Plan ==")[0] and "_salt" not in plan
        assert joined.count() == rows and joined.where("v <> k % 7").count() == 0


def test_spark_does_not_broadcast_a_lookup_judged_too_large(spark, tmp_path):
    """Its file is far below Spark's default threshold of 10 MB, its rows are above the limit."""
    keys = [BROADCAST_THRESHOLD, ADAPTIVE_BROADCAST_THRESHOLD]
    before = {key: spark.conf.get(key, None) for key in keys}
    lookup = spark.range(0, 600_000, 1, 1).select(F.col("id").alias("k"), F.hash("id").alias("v"))
    lookup.write.parquet(f"{tmp_path}/t")
    lookup = spark.read.schema("k long, v int").parquet(f"{tmp_path}/t")
    limits = replace(Params(), broadcast_limit_bytes=16 * 1024 * 1024)
    fact = spark.range(0, 1_200_000, 2).select("id", F.col("id").alias("k"))
    try:
        for key in keys:
            spark.conf.set(key, "10MB")
        apply_runtime_settings(spark)
        assert joins.estimated_bytes(lookup) < 10 * 1024 * 1024 and limits.broadcast_limit_bytes < joins.held_bytes(lookup)
        joined = joins.lookup_join(fact, lookup, ["k"], limits, "left", fact, ["id"])
        rows = joined.agg(F.count("*"), F.count("v"))
        assert tuple(rows.first()) == (600_000, 300_000)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("given, kept", [("-1", "-1"), ("256k", "256k"), ("10MB", "1048576"), ("1m", "1m")])
def test_smaller_broadcast_thresholds_stay(spark, given, kept):
    before = spark.conf.get(BROADCAST_THRESHOLD)
    try:
        spark.conf.set(BROADCAST_THRESHOLD, given)
        apply_runtime_settings(spark)
        assert spark.conf.get(BROADCAST_THRESHOLD) == kept
        assert spark.conf.get(ADAPTIVE_BROADCAST_THRESHOLD, None) is None
    finally:
        spark.conf.set(BROADCAST_THRESHOLD, before)


def test_held_bytes_counts_rows_and_texts(spark):
    df = spark.createDataFrame([(1, "abc", ["x"]), (2, None, None), (None, "\u00e9", ["y", "zz"])], "k long, s string, a array<string>")
    texts = 3 + 2 + len("[x]") + len("[y, zz]")
    assert joins.held_bytes(df) == 3 * (joins.ROW_BYTES + 3 * 8) + texts
    assert joins.held_bytes(df.where("k > 5")) == 0


@pytest.mark.parametrize("descending", [True, False])
def test_global_rank_equals_window_rank(spark, descending):
    value = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 3 == 0, 0.0).otherwise(
        F.sin(F.col("id")) * F.pow(F.lit(10.0), F.col("id") % 9 - 4)
    )
    df = spark.range(500).select("id", value.cast("double").alias("x"))
    got = ranking.add_global_rank(df, "x", "r", ["id"], TINY, descending)
    order = F.col("x").desc_nulls_last() if descending else F.col("x").asc_nulls_last()
    want = df.withColumn("r", F.rank().over(Window.orderBy(order)))
    assert sorted(map(tuple, got.where("x is not null").select("id", "r").collect())) == sorted(
        map(tuple, want.where("x is not null").select("id", "r").collect())
    )


def test_percent_rank(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.5), (4, 0.9), (5, None)], "id int, x double")
    got = ranking.add_global_rank(df, "x", "p", ["id"], TINY, percent=True).where("x is not null")
    assert {r.id: r.p for r in got.collect()} == {2: 0.0, 1: pytest.approx(1 / 3), 3: pytest.approx(1 / 3), 4: 1.0}


def test_ranges_are_even_for_a_narrow_distribution(spark):
    """200,000 distinct values inside one power of two, and one value that a third of the rows share."""
    value = F.when(F.col("id") % 3 == 0, 1.5).otherwise(1 + F.pow(F.col("id") / 300_000, 9) / 1e6)
    df = spark.range(300_000).select("id", value.alias("x"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = ranking.ranges(df.groupBy("x").count(), "x")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    sizes = sorted(r["count"] for r in ranged.groupBy("_part").count().collect())
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = ranking.add_global_rank(df, "x", "r", ["id"], TINY).where("id % 997 = 0")
    ordered = sorted(1.5 if i % 3 == 0 else 1 + (i / 300_000) ** 9 / 1e6 for i in range(300_000))
    first = {}
    for n, v in enumerate(ordered, start=1):
        first.setdefault(v, n)
    rows = got.collect()
    assert len(rows) == 301 and all(abs(r.r - first.get(r.x, r.r)) == 0 for r in rows)
    assert {r.r for r in rows if r.x == 1.5} == {200_001}


def test_dense_id(spark):
    df = spark.range(300).select(F.concat(F.lit("order-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    rows = ranking.add_dense_id(df.repartition(7), ["k"], "n").orderBy("k").collect()
    assert [r.n for r in rows] == list(range(300))
