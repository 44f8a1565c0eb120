"""Validations of landed series and reshapes of API answers."""

from datetime import date

import pytest

from promiselens.operators import checks, series
from promiselens.sources import payloads

RATES = "date date, rate double"


def test_rates_keep_the_published_value(spark):
    payload = spark.createDataFrame(
        [("EUR", {"2017-01-02": {"BRL": 3.4305}, "2017-01-03": {"BRL": 3.4412, "USD": 1.0}, "2017-01-04": {"USD": 1.0}})],
        "base string, rates map<string, map<string, double>>",
    )
    rows = payloads.rate_map_to_rows(payload).orderBy("date").collect()
    assert [(r.date.day, r.base, r.quote, r.rate) for r in rows] == [
        (2, "EUR", "BRL", 3.4305), (3, "EUR", "BRL", 3.4412), (4, "EUR", "BRL", None),
    ]
    assert payloads.rate_map_to_rows(payload, base="USD").isEmpty()


def test_implausible_and_missing_values(spark):
    df = spark.createDataFrame([(date(2017, 1, 2), 34.305), (date(2017, 1, 3), None), (date(2017, 1, 4), 3.4)], RATES)
    assert series.implausible(df, "rate", 2, 8).count() == 2
    assert series.missing_values(df, ["date", "rate"]).count() == 1
    assert series.missing_fields(df, ["date", "base", "quote"]) == ["base", "quote"]
    with pytest.raises(ValueError):
        series.require_rows(df.where("rate > 100"), "rates")


def test_gap_longer_than_a_break(spark):
    df = spark.createDataFrame([(date(2017, 1, 2), 3.4), (date(2017, 1, 20), 3.5), (date(2017, 1, 25), 3.5)], RATES)
    assert [(r.date, r.gap_days) for r in series.gaps(df, "date", 5).collect()] == [(date(2017, 1, 20), 18)]
    assert series.uncovered(df, "date", date(2017, 1, 1), date(2017, 1, 26)).count() == 1
    assert series.uncovered(df, "date", date(2017, 1, 2), date(2017, 1, 30)).count() == 0
    assert series.uncovered(df, "date", date(2017, 1, 2), date(2017, 1, 31)).count() == 1


def test_wrong_year_or_country(spark):
    df = spark.createDataFrame([(date(2017, 1, 1), "BR"), (date(2018, 1, 1), "BR"), (date(2017, 1, 1), "AR")], "date date, c string")
    assert series.wrong_partition(df, "date", 2017, c="BR").count() == 2


def weather(spark, days, rain):
    daily = (days, rain, [30.0] * len(days), [20.0] * len(days))
    return spark.createDataFrame(
        [("SP", -23.5, -46.6, "America/Sao_Paulo", daily)],
        "state_code string, latitude double, longitude double, timezone string, daily struct<time: array<string>, "
        "precipitation_sum: array<double>, temperature_2m_max: array<double>, temperature_2m_min: array<double>>",
    )


def test_arrays_become_one_row_per_day(spark):
    rows = payloads.daily_arrays_to_rows(weather(spark, ["2017-01-01", "2017-01-02", "2017-01-03"], [None, 25.5, None]))
    kept = series.without_trailing_blanks(rows, "time", "precipitation_sum", "state_code").orderBy("time").collect()
    assert [(r.time, r.precipitation_sum, r.grid_latitude) for r in kept] == [
        ("2017-01-01", None, -23.5), ("2017-01-02", 25.5, -23.5),
    ]


@pytest.mark.parametrize("days, rain, bad", [
    (["2017-01-01", "2017-01-02"], [1.0, 2.0], 0), (["2017-01-01"], [1.0], 1), (["2017-01-01", "2017-01-02"], [1.0], 1),
    (["2017-01-01", "2017-01-03"], [1.0, 2.0], 1),
])
def test_incomplete_days(spark, days, rain, bad):
    payload = weather(spark, days, rain).select("state_code", "daily.*")
    assert series.incomplete_days(payload, "time", date(2017, 1, 1), date(2017, 1, 2), ["precipitation_sum"]).count() == bad


def test_both_inflation_answers_give_the_same_rows(spark):
    coded = spark.createDataFrame([("Month (code)", "Value"), ("202607", "0.07"), ("202608", "-0.32")], "D3C string, V string")
    text = spark.createDataFrame([("01/07/2026", "0.07"), ("01/08/2026", "-0,32")], "data string, valor string")
    rows = [tuple(r) for r in payloads.coded_months_to_rows(coded).orderBy("month").collect()]
    assert rows == [("2026-07", 0.07), ("2026-08", -0.32)]
    assert rows == [tuple(r) for r in payloads.monthly_text_to_rows(text).orderBy("month").collect()]


def test_state_filter(spark):
    df = spark.createDataFrame([("SP",), ("RJ",)], "s string")
    assert series.of_keys(df, "s", ["sp"]).count() == 1 and series.of_keys(df, "s", None).count() == 2


def months(spark, *numbers):
    return spark.createDataFrame([(date(2026, n, 1), 0.1) for n in numbers], "month_start date, pct_change double")


def test_missing_months_and_staleness(spark):
    assert series.missing_months(months(spark, 1, 2, 4), "month_start").first().months_missing == 1
    assert series.missing_months(months(spark, 1, 2, 3), "month_start").isEmpty()
    assert series.stale(months(spark, 1, 2), "month_start", date(2026, 5, 20)).isEmpty()
    assert series.stale(months(spark, 1, 2), "month_start", date(2026, 6, 1)).first().months_old == 4


def test_source_order(spark):
    good, gap = months(spark, 1, 2, 3), months(spark, 1, 3)

    def chosen(primary, backup):
        sources = {"primary": primary, "backup": backup}
        found = {n: [series.missing_months(df, "month_start")] for n, df in sources.items()}
        return {r.source for r in series.first_valid_source(sources, found).collect()}

    assert chosen(good, good) == {"primary"} and chosen(gap, good) == {"backup"} and chosen(gap, gap) == set()


def test_required_years():
    assert payloads.required_years(2016, 2018, 2026) == [2016, 2017, 2018, 2026, 2027]
    assert payloads.required_years(2016, 2018, 2026, live_only=True) == [2026, 2027]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 0), (None, "c", None)], "k int, v string, n int")
    assert checks.unique(df, "k").collect()[0].rows == 2
    assert checks.not_null(df, "k").count() == 1
    assert checks.accepted_values(df, "v", ["a", "b"]).first().v == "c"
    assert checks.accepted_range(df, "n", low=0).count() == 0
    assert checks.accepted_range(df, "n", low=0, inclusive=False).count() == 1
    assert checks.expression_holds(df, "n > 3").count() == 1
    assert checks.expression_holds(df, "n > 3", strict=True).count() == 2
    assert checks.expression_holds(df, "n > 3", where="v = 'a'").count() == 0
    assert checks.relationship(df, "k", spark.createDataFrame([(2,)], "id int"), "id").first().rows == 2
    assert checks.equal_rowcount(df, df).count() == 0 and checks.equal_rowcount(df, df.limit(1)).count() == 1
