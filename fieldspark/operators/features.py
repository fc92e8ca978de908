"""Chronological features per asset.

All row-offset features share one window specification, so they cost one shuffle and one sort. `slice_unit=None` is meant
for monthly panels, whose groups are bounded by the calendar; for raw telemetry give a slice unit and a large asset is
split over time slices with identical results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import deviation_fraction, hyperbolic_rate, safe_div
from fieldspark.operators.sliced import over_slices

ASSET = ("asset_id",)


def trailing_slope(value: str, window, span: int, min_rows: int, skip: int = 0) -> Column:
    """OLS slope of the last `span` rows against their position, `skip` rows back; closed form over lags."""
    frame = window.rowsBetween(-(span + skip - 1), -skip)
    n = F.count(value).over(frame).cast("double")
    top = F.lit(0.0)
    for k in range(span):
        past = F.lag(value, k + skip).over(window) if k + skip else F.col(value)
        top = top + F.when(n > k, ((n - 1) / 2 - k) * past).otherwise(0.0)
    return F.when(n >= max(min_rows, 2), top * 12.0 / F.nullif(n * (n * n - 1), F.lit(0.0)))


def row_features(window, value: str = "production", roll: int = 3, trend: int = 6) -> dict[str, Column]:
    x = F.col(value)
    prev = F.lag(value, 1).over(window)
    before = F.avg(value).over(window.rowsBetween(-roll, -1))
    return {
        "production_lag_1": prev,
        "production_lag_3": F.lag(value, 3).over(window),
        "production_lag_6": F.lag(value, 6).over(window),
        "rolling_mean": F.avg(value).over(window.rowsBetween(-(roll - 1), 0)),
        "rolling_std": F.coalesce(F.stddev_pop(value).over(window.rowsBetween(-(roll - 1), 0)), F.lit(0.0)),
        "decline_rate": F.coalesce(-safe_div(x - prev, prev), F.lit(0.0)),
        "trend_slope": trailing_slope(value, window, trend, min(3, trend)),
        "production_deviation": F.coalesce(safe_div(x - before, before), F.lit(0.0)),
    }


def seasonal_factor(df: DataFrame, value: str = "production", time_col: str = "timestamp",
                    keys: Sequence[str] = ASSET) -> DataFrame:
    """Adds `seasonal_factor`: month-of-year mean over the asset's mean, 1 where that mean is not positive."""
    month = F.month(time_col)
    sums = df.groupBy(*keys, month.alias("_month")).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    asset = Window.partitionBy(*keys)  # at most twelve rows per asset
    overall = safe_div(F.sum("s").over(asset), F.sum("c").over(asset))
    factors = sums.withColumn(
        "seasonal_factor", F.when(overall > 0, safe_div(F.col("s"), F.col("c")) / overall).otherwise(1.0)).drop("s", "c")
    return df.withColumn("_month", month).join(factors, [*keys, "_month"]).drop("_month")


def build_features(df: DataFrame, value: str = "production", time_col: str = "timestamp", roll: int = 3, trend: int = 6,
                   keys: Sequence[str] = ASSET, slice_unit: str | None = "day") -> DataFrame:
    """The nine telemetry features. One row per (asset, timestamp) is assumed."""
    rows = over_slices(df, list(keys), [time_col], lambda w: row_features(w, value, roll, trend),
                       max(6, roll, trend - 1), time_col, slice_unit)
    return seasonal_factor(rows, value, time_col, keys)


def seasonal_index(panel: DataFrame, value: str = "actual", keys: Sequence[str] = ASSET) -> DataFrame:
    """Per asset and position 0..11: mean over the overall mean, smoothed circularly with .25/.5/.25.

    Ones for assets with under twelve rows or a mean that is not positive.
    """
    sums = panel.groupBy(*keys, F.pmod("t", F.lit(12)).alias("pos")).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    per = sums.groupBy(*keys).agg(
        F.sum("c").alias("n"), safe_div(F.sum("s"), F.sum("c")).alias("overall"),
        F.map_from_entries(F.collect_list(F.struct("pos", safe_div(F.col("s"), F.col("c")).alias("m")))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.col("m")[i] / F.col("overall"), F.lit(1.0)))
    usable = (F.col("n") >= 12) & (F.col("overall") > 0)
    held = per.withColumn("raw", F.when(usable, raw).otherwise(F.array_repeat(F.lit(1.0), 12)))
    smooth = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(
        i.alias("pos"),
        (0.25 * F.col("raw")[F.pmod(i + 11, F.lit(12))] + 0.5 * F.col("raw")[i]
         + 0.25 * F.col("raw")[F.pmod(i + 1, F.lit(12))]).alias("index")))
    return held.select(*keys, F.explode(F.when(usable, smooth).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(i.alias("pos"), F.lit(1.0).alias("index")))
    )).alias("p")).select(*keys, "p.pos", "p.index")


def calendar_factors(panel: DataFrame, value: str = "actual", period: str = "period", keys: Sequence[str] = ASSET) -> DataFrame:
    """Per asset and calendar month 1..12: mean over the count-weighted mean; 0 for a month without data."""
    sums = panel.groupBy(*keys, F.month(period).alias("month")).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    per = sums.groupBy(*keys).agg(
        safe_div(F.sum("s"), F.sum("c")).alias("overall"),
        F.map_from_entries(F.collect_list(F.struct("month", safe_div(F.col("s"), F.col("c")).alias("m")))).alias("m"))
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    factor = F.when(F.col("overall") > 0, F.coalesce(F.col("m")[F.col("month")], F.lit(0.0)) / F.col("overall")).otherwise(1.0)
    return per.select(*keys, "overall", "m", months).select(*keys, "month", factor.alias("factor"))


def detector_exprs(w) -> dict[str, Column]:
    prev = F.lag("actual").over(w)
    return {
        "rolling_mean": F.avg("actual").over(w.rowsBetween(-2, 0)),
        "rolling_std": F.coalesce(F.stddev_samp("actual").over(w.rowsBetween(-2, 0)), F.lit(0.0)),
        "change_rate": F.coalesce(safe_div(F.col("actual") - prev, prev), F.lit(0.0)),
    }


def anomaly_features(panel: DataFrame, order: str = "period", keys: Sequence[str] = ASSET, slice_unit: str | float | None = None,
                     more: Callable | None = None, back: int = 2) -> DataFrame:
    """Detector features: level, deviation fraction, rolling mean and sample std of three, change on the month before.

    Rows without actual or expected are dropped first. The change keeps its sign (a decline is negative), unlike
    `decline_rate` of the telemetry features. `more` adds expressions over the same window that look `back` rows behind.
    """
    rows = panel.where(F.col("actual").isNotNull() & F.col("expected").isNotNull())
    rows = rows.withColumn("dev_fraction", deviation_fraction(F.col("actual"), F.col("expected")))
    return over_slices(rows, list(keys), [order], lambda w: detector_exprs(w) | (more(w) if more else {}), max(2, back), order, slice_unit)


def coverage_zscores(panel: DataFrame, cols: Sequence[str], keys: Sequence[str] = ASSET) -> DataFrame:
    """z-score per operational column where at least max(3, half the rows) are known; NULL column and flag otherwise."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"_n_{c}"), F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    stats = panel.groupBy(*keys).agg(*aggs)
    out = panel.join(stats, list(keys))
    new = {}
    for c in cols:
        enough = F.col(f"_n_{c}") >= F.greatest(F.lit(3), F.floor(F.col("_rows") * 0.5))
        spread = F.when(F.col(f"_s_{c}") == 0, 1e-9).otherwise(F.col(f"_s_{c}"))
        new[f"has_{c}"] = enough
        new[f"{c}_z"] = F.when(enough, F.coalesce((F.col(c) - F.col(f"_m_{c}")) / spread, F.lit(0.0)))
    return out.withColumns(new).drop("_rows", *[f"_{p}_{c}" for c in cols for p in "nms"])


FORECAST_FEATURES = (
    "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "roll3_mean", "roll6_mean", "roll3_std", "decline_rate", "trend_slope",
    "sin12", "cos12", "decline_baseline")


def forecast_features(panel: DataFrame, value: str = "actual", keys: Sequence[str] = ASSET,
                      params: Sequence[str] | None = ("qi", "di", "b"), metadata: Sequence[str] = ()) -> DataFrame:
    """Features for predicting row t from rows before t only (the target never enters its own row).

    Metadata columns are appended in name order as meta_<name>.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def lag(k: int) -> Column:
        return F.coalesce(F.lag(value, k).over(w), first)

    angle = F.pmod("t", F.lit(12)) * (2 * math.pi / 12.0)
    feats = {f"lag_{k}": lag(k) for k in (1, 2, 3, 6, 12)}
    feats |= {
        "roll3_mean": F.avg(value).over(w.rowsBetween(-3, -1)),
        "roll6_mean": F.avg(value).over(w.rowsBetween(-6, -1)),
        "roll3_std": F.stddev_pop(value).over(w.rowsBetween(-3, -1)),
        "decline_rate": -(lag(1) - lag(2)) / F.greatest(F.abs(lag(2)), F.lit(1e-9)),
        "trend_slope": F.coalesce(trailing_slope(value, w, 6, 2, skip=1), F.lit(0.0)),
        "sin12": F.sin(angle), "cos12": F.cos(angle),
    }
    if params:
        qi, di, b = (F.col(p) for p in params)
        feats["decline_baseline"] = hyperbolic_rate(qi, di, b, F.col("t").cast("double"))
    for m in sorted(metadata):
        feats[f"meta_{m}"] = F.coalesce(F.col(m).cast("double"), F.lit(0.0))
    return panel.withColumns(feats)


def supervised_matrix(features: DataFrame, warmup: int = 13, min_rows: int = 8,
                      keys: Sequence[str] = ASSET) -> tuple[DataFrame, DataFrame]:
    """(rows after the warm-up of assets with enough of them, assets that have too few)."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = features.where(F.col("t") >= warmup).withColumn("_n", size)
    short = features.groupBy(*keys).agg(F.count_if(F.col("t") >= warmup).alias("usable_rows")).where(
        F.col("usable_rows") < min_rows)
    return rows.where(F.col("_n") >= min_rows).drop("_n"), short


def volatility(panel: DataFrame, value: str = "actual", keys: Sequence[str] = ASSET) -> DataFrame:
    """Per asset: sample std of the month-over-month change, and the slope of the last twelve months."""
    w = Window.partitionBy(*keys).orderBy("t")
    prev = F.lag(value).over(w)
    last = F.max("t").over(Window.partitionBy(*keys))
    rows = panel.withColumns({"_pct": safe_div(F.col(value) - prev, prev), "_recent": F.col("t") > last - 12})
    y = F.when(F.col("_recent"), F.col(value))
    return rows.groupBy(*keys).agg(
        F.stddev_samp("_pct").alias("volatility"),
        F.when(F.count(y) >= 2, F.regr_slope(y, F.col("t").cast("double"))).alias("trend12"))
