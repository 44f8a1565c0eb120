"""Declared checks, mergeable percentiles, rejected records and digests of large files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from promiselens.operators import declared, sketches
from promiselens.operators.declared import holds, in_range, key, not_null, one_of, refers, unique_combination
from promiselens.plans.declarations import DECLARED
from promiselens.sources import digests, registry


def test_every_kind_finds_its_violations(spark):
    tables = {
        "parent": spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, name string"),
        "child": spark.createDataFrame(
            [(1, 1, 5.0, "x"), (1, 1, 0.0, "y"), (9, 2, -1.0, "z"), (9, 2, None, None), (None, None, 7.5, "x"), (None, None, 1.0, "x")],
            "parent_id long, part int, price double, kind string",
        ),
    }
    rules = {
        "parent": key("id") + not_null("name"),
        "child": unique_combination("parent_id", "part") + refers("parent_id", "parent", "id") + in_range("price", 0, inclusive=False)
        + in_range("price", 0, 7) + one_of("kind", "x", "y") + holds("price < 5", "kind = 'x'") + holds("part = 1"),
    }
    found = {(r["table"], r["check"]): r["violations"] for r in declared.report(tables, rules).collect()}
    assert found == {
        ("parent", "unique: id"): 1, ("parent", "not_null: id"): 1, ("parent", "not_null: name"): 0,
        ("child", "unique_combination: parent_id, part"): 3, ("child", "relationship: parent_id"): 1,
        ("child", "accepted_range: price above 0"): 2, ("child", "accepted_range: price from 0 to 7"): 2,
        ("child", "accepted_values: kind"): 1,
        ("child", "expression: price < 5 where kind = 'x'"): 2, ("child", "expression: part = 1"): 2,
    }


def test_one_scan_and_one_grouping_serve_many_checks(spark):
    parent = spark.range(5)
    children = {f"c{n}": spark.range(n, n + 3) for n in range(3)}
    rules = {"parent": key("id")} | {name: refers("id", "parent", "id") for name in children}
    plan = declared.report({"parent": parent, **children}, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [_k0") == 1 and "Join" not in plan


def test_declarations_are_complete():
    kinds = [c.kind for checks in DECLARED.values() for c in checks]
    assert len(kinds) == 118 and len(DECLARED) == 38
    labels = [(t, c.label()) for t, checks in DECLARED.items() for c in checks]
    assert len(set(labels)) == len(labels)


def test_merged_sketches_keep_their_rank_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 400).alias("cell"), F.pmod(F.hash("id"), F.lit(50_000)).alias("days"))
    cells = sketches.sketched(rows.withColumn("days", F.when(F.col("days") % 10 != 0, F.col("days"))), ["cell"], "days")
    rolled = sketches.rolled_up(cells.withColumn("level", F.col("cell") % 3), ["level"])
    assert rolled.agg(F.sum(sketches.rows_of())).first()[0] == rows.where("days % 10 != 0").count()
    for p in (0.01, 0.5, 0.9):
        for r in rolled.select("level", sketches.percentile_of(p).alias("q")).collect():
            own = rows.where((F.col("days") % 10 != 0) & (F.col("cell") % 3 == r["level"]))
            below = own.select(F.avg((F.col("days") < r["q"]).cast("double"))).first()[0]
            assert abs(below - p) < 2 * sketches.rank_error()


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    sizes = {"large.csv": (1 << 31) + 12_345, "small.csv": 10, "empty.csv": 0}
    expected = {}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as file:
            file.truncate(size)
        digest = hashlib.sha256()
        left, block = size, bytes(1 << 22)
        while left:
            digest.update(block[: min(left, len(block))])
            left -= min(left, len(block))
        expected[name] = (size, digest.hexdigest())
    del expected["empty.csv"]  # Spark lists no file without a byte
    found = {os.path.basename(r["path"]): (r["bytes"], r["sha256"]) for r in digests.digests(spark, str(tmp_path)).collect()}
    assert found == expected
    reader = digests.DigestReader([("a", 200 << 20), ("b", 3), ("c", 4)])
    assert [p.value for p in reader.partitions()] == [["a"], ["c", "b"]]


@pytest.fixture
def landed(tmp_path):
    shop, fx = tmp_path / "shop", tmp_path / "fx"
    shop.mkdir()
    fx.mkdir()
    (shop / "x_sellers_dataset.csv").write_text(
        "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,são paulo,SP\ns2,01000,too,many,fields\ns3,few\n"
    )
    (shop / "y_sellers_dataset.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns4,02000,rio,RJ\n")
    (fx / "fx_EUR_BRL.ndjson").write_text('{"date": "2018-01-02", "base": "EUR", "quote": "BRL", "rate": 3.9}\n{"date": \n')
    return str(tmp_path)


def test_rejected_records_are_kept_and_counted(spark, landed):
    checked = registry.load_checked(spark, landed, "sellers")
    report = {os.path.basename(r["file"]): tuple(r)[2:] for r in registry.landing_report(checked, "sellers").collect()}
    assert report == {"x_sellers_dataset.csv": (3, 1, 2), "y_sellers_dataset.csv": (1, 1, 0)}
    assert {r["record"] for r in registry.rejects(checked, "sellers").collect()} == {"s2,01000,too,many,fields", "s3,few"}
    good = registry.accepted(checked)
    assert good.columns == registry.load_raw(spark, landed, "sellers").columns
    assert {r["seller_id"] for r in good.collect()} == {"s1", "s4"}
    rates = registry.load_checked(spark, landed, "fx_rates")
    assert [r["record"] for r in registry.rejects(rates, "fx_rates").collect()] == ['{"date": ']
    assert registry.accepted(rates).count() == 1


def test_missing_tables(spark, landed):
    missing = {r["table"] for r in registry.missing_tables(spark, landed).collect()}
    assert missing == set(registry.RAW_TABLES) - {"sellers", "fx_rates"}


def test_landing_again_replaces_as_a_whole(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from promiselens.sources import landing, sinks

    def months(n):
        return SimpleNamespace(spark=spark, inflation=spark.range(n).selectExpr("date'2018-01-01' as month_start", "0.5D as pct_change"))

    def rows():
        return registry.load_raw(spark, landing.current(spark, str(tmp_path)), "inflation_monthly").count()

    def stops(feed, root):
        raise RuntimeError("stopped")

    monkeypatch.setattr(landing, "LAND", {"inflation": landing.land_inflation})
    with pytest.raises(FileNotFoundError):
        landing.current(spark, str(tmp_path))
    landing.land_all(months(3), str(tmp_path))
    assert rows() == 3
    monkeypatch.setattr(landing, "LAND", {"inflation": landing.land_inflation, "weather": stops})
    with pytest.raises(RuntimeError):
        landing.land_all(months(5), str(tmp_path))
    assert rows() == 3
    monkeypatch.setattr(landing, "LAND", {"inflation": landing.land_inflation})
    landing.land_all(months(4), str(tmp_path))
    assert rows() == 4 and sinks.latest_generation(spark, str(tmp_path))[0] == 2
