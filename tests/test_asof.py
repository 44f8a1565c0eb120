"""As-of join and forward fill over ranges of time equal plain versions."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promiselens.operators import asof

START = datetime(2020, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


@pytest.fixture
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, held)


def test_as_of_join(spark, many_ranges):
    rng = random.Random(2)
    left = [(n, rng.choice([None, *range(0, 500)])) for n in range(300)] + [(900, 0), (901, 10_000)]
    # Half of what is known lies in one minute, long stretches know nothing, and one value is null.
    right = [(n, 250 if n % 2 else rng.choice([40, 41, 300, 470]), float(n)) for n in range(80)] + [(99, None, 1.0), (100, 471, None)]
    a = spark.createDataFrame([(n, at(m)) for n, m in left], "id int, t timestamp_ntz").withColumn("_time", F.lit("kept"))
    b = spark.createDataFrame([(n, at(m), v) for n, m, v in right], "n int, known timestamp_ntz, v double")
    found = {r["id"]: (r["n"], r["v"], r["_time"]) for r in asof.as_of_join(a, b, "t", "known", ["n", "v"], "n").collect()}
    best = {}
    for n, m, v in right:
        if m is not None and n >= best.get(m, (-1,))[0]:
            best[m] = (n, v)
    times = sorted(best)
    for n, m in left:
        k = 0 if m is None else bisect.bisect_right(times, m)
        assert found[n] == (*(best[times[k - 1]] if k else (None, None)), "kept"), n
    assert len(found) == len(left)
    assert asof.as_of_join(a, b.limit(0), "t", "known", ["v"], "n").where("v is not null").isEmpty()
    assert asof.as_of_join(a.limit(0), b, "t", "known", ["v"], "n").isEmpty()


def test_forward_fill(spark, many_ranges):
    rng = random.Random(3)
    values = [rng.random() if rng.random() < 0.02 else None for _ in range(1000)]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "t int, v double")
    filled = asof.forward_filled(df, "t", "v")
    last, expected = None, {}
    for n, v in enumerate(values):
        last = v if v is not None else last
        expected[n] = last
    assert {r["t"]: r["v"] for r in filled.collect()} == expected
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [last(v" in plan and "[_part" in plan.split("Window [last(v")[1].splitlines()[0]
