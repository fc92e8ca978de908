import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import clean, features, quality, sliced
from fieldspark.operators.quantiles import group_percentiles
from tests.conftest import TELEMETRY_DDL, daily


def test_units_drop_every_third_row(spark):
    df = spark.createDataFrame(daily(9), TELEMETRY_DDL).withColumn(
        "pressure", F.when(F.dayofmonth("timestamp") % 3 == 0, 99999.0).otherwise(10.0))
    assert clean.validate_units(df).count() == 6
    assert clean.unit_violations(df).first()["pressure_violations"] == 3


def test_unit_conversion_factor(spark):
    df = spark.createDataFrame(daily(1), TELEMETRY_DDL).withColumn("pressure", F.lit(15.0))
    assert clean.convert_units(df, {"pressure": ("psi", 0.0689476), "absent": ("x", 2.0)}).first()["pressure"] == pytest.approx(1.034214)


@pytest.mark.parametrize("keep, want", [("last", 2.0), ("first", 1.0)])
def test_dedupe_uses_the_given_order(spark, keep, want):
    ts = datetime(2026, 1, 1)
    df = spark.createDataFrame([("A", ts, 2.0, 2), ("A", ts, 1.0, 1)], "asset_id string, timestamp timestamp, production double, n int")
    assert clean.dedupe(df.repartition(3), ("n",), keep).first()["production"] == want


def test_monthly_counts(spark):
    out = clean.resample_monthly(spark.createDataFrame(daily(90), TELEMETRY_DDL).withColumns(
        {c: F.lit(None).cast("double") for c in ("pressure", "temperature", "flow_rate")}).withColumn("valve_status", F.lit(None).cast("string")))
    assert [r.sample_count for r in out.orderBy("timestamp").collect()] == [31, 28, 31]


def test_constant_series_has_no_outliers(spark):
    df = spark.createDataFrame([("A", float(i), 5.0) for i in range(20)] + [("B", 0.0, 1.0)], "asset_id string, n double, production double")
    assert clean.outlier_flags(df).where("is_outlier").count() == 0


@pytest.mark.parametrize("method", ["sort", "bracket"])
@pytest.mark.parametrize("n", [1, 2, 7, 12000])
def test_percentiles_equal_pandas(spark, n, method):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.choice([rng.gauss(0, 10), 3.0])) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in group_percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.999}, method).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    for k, g in pdf.groupby("k"):
        for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.999)):
            assert got[k][name] == pytest.approx(g.v.quantile(p), abs=1e-9)


def test_percentile_bracket_of_a_large_group(spark):
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.pow(F.rand(7), 3.0).alias("v"))
    df = df.unionByName(spark.range(100_000).select(F.lit("k").alias("k"), F.lit(0.125).alias("v"))).persist()
    exact = group_percentiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, "sort").first()
    bracket = group_percentiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, "bracket").first()
    assert (exact["m"], exact["q"]) == pytest.approx((bracket["m"], bracket["q"]))


def _series(spark, n=400):
    rng = random.Random(3)
    first = datetime(2026, 1, 1)
    rows = []
    for asset, step in (("A", 1), ("B", 37), ("C", 700)):
        at = first
        for _ in range(n // step + 3):
            at += timedelta(minutes=rng.randint(1, 240) * step)
            rows.append((asset, at, float(rng.randint(0, 50)), None if rng.random() < 0.4 else rng.random()))
    return spark.createDataFrame(rows, "asset_id string, timestamp timestamp, production double, pressure double")


def test_sliced_features_equal_plain_windows(spark):
    df = _series(spark)
    plain = features.build_features(df, slice_unit=None)
    parts = features.build_features(df.repartition(7), slice_unit="day")
    cols = sorted(plain.columns)
    left = sorted([tuple(r) for r in plain.select(*cols).collect()], key=str)
    right = sorted([tuple(r) for r in parts.select(*cols).collect()], key=str)
    assert len(left) == len(right) == df.count()
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, abs=1e-9))


def test_sliced_row_numbers(spark):
    df = _series(spark)
    got = sliced.row_numbers(df, ["asset_id"], ["timestamp"], "timestamp", "day", "rn", "n").toPandas().sort_values(["asset_id", "timestamp"])
    for _, g in got.groupby("asset_id"):
        assert list(g.rn) == list(range(1, len(g) + 1)) and set(g.n) == {len(g)}


def test_imputation_equals_pandas_and_spares_real_rows(spark):
    df = _series(spark).withColumn("source_type", F.when(F.col("asset_id") == "B", "REAL").otherwise("DERIVED"))
    got = clean.impute_time(df, ["pressure"], "day").toPandas()
    src = df.toPandas()
    for asset, g in src.groupby("asset_id"):
        s = g.sort_values("timestamp").set_index("timestamp").pressure
        want = s if asset == "B" else s.interpolate(method="time", limit_direction="both")
        have = got[got.asset_id == asset].sort_values("timestamp").pressure
        assert list(have.fillna(-1)) == pytest.approx(list(want.fillna(-1)), abs=1e-9)


def test_monthly_linear_features(spark):
    rows = [("A", datetime(2025 + (i // 12), i % 12 + 1, 1), 100.0 - 2 * i) for i in range(13)]
    df = spark.createDataFrame(rows, "asset_id string, timestamp timestamp, production double")
    out = features.build_features(df, slice_unit=None).orderBy("timestamp").collect()
    assert out[0].production_lag_1 is None and out[1].production_lag_1 == 100.0 and out[6].production_lag_6 == 100.0
    assert out[2].rolling_mean == pytest.approx(98.0) and out[0].decline_rate == 0.0
    assert out[1].decline_rate == pytest.approx(0.02) and out[8].trend_slope == pytest.approx(-2.0)
    assert out[1].trend_slope is None


def test_decline_rate_of_zero_is_zero(spark):
    rows = [("A", datetime(2026, 1, 1 + i), v) for i, v in enumerate([0.0, 5.0, 0.0])]
    out = features.build_features(spark.createDataFrame(rows, "asset_id string, timestamp timestamp, production double"), slice_unit=None)
    assert [r.decline_rate for r in out.orderBy("timestamp").collect()] == [0.0, 0.0, 1.0]


def test_low_coverage_excludes_a_feature(spark):
    rows = [("A", i, float(i) if i < 3 else None) for i in range(20)]
    out = features.coverage_zscores(spark.createDataFrame(rows, "asset_id string, t int, pressure double"), ["pressure"]).first()
    assert out["has_pressure"] is False and out["pressure_z"] is None


def test_chrono_split_sizes(spark):
    df = spark.createDataFrame(daily(40, "A") + daily(20, "B") + daily(1, "C"), TELEMETRY_DDL)
    got = {(r.asset_id, r.split): r["count"] for r in clean.chrono_split(df, 0.8).groupBy("asset_id", "split").count().collect()}
    assert got == {("A", "train"): 32, ("A", "test"): 8, ("B", "train"): 16, ("B", "test"): 4, ("C", "train"): 1}
    with pytest.raises(ValueError):
        clean.chrono_split(df, 1.0)


def test_quality_report_counts_duplicates(spark):
    rows = daily(8) + daily(1) + [("A-1", datetime(2026, 3, 1), 1.0, None, "SYNTHETIC")]
    out = quality.quality_report(spark.createDataFrame(rows, TELEMETRY_DDL)).first()
    assert out["duplicate_count"] == 1 and out["number_of_rows"] == 10 and out["missing_source"] == 1


def test_provenance_label(spark):
    df = spark.createDataFrame([("R", "REAL"), ("D", "DERIVED"), ("M", "REAL"), ("M", "DERIVED"), ("S", "REAL"), ("S", "SYNTHETIC"), ("N", None)],
                               "asset_id string, source_type string")
    got = {r.asset_id: r.provenance for r in quality.provenance_label(df).collect()}
    assert got == {"R": "REAL", "D": "DERIVED", "M": "SYNTHETIC", "S": "SYNTHETIC", "N": "SYNTHETIC"}
