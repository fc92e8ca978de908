"""Decline curves per asset.

A monthly series is one bounded array per asset (one value per calendar month), so a fit is one shuffle to build the
arrays and then only row-local work: no join with the parameter grid and no second shuffle. The (di, b) search runs on
Arrow batches of series; everything else stays in column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.config import DAYS_PER_MONTH, HORIZON_DAYS
from fieldspark.functions import curve_search
from fieldspark.functions.columns import clamp, hyperbolic_rate
from fieldspark.functions.curve_search import B_MAX, B_MIN, DI_MAX, DI_MIN, fit_batch, grid_batch

cloudpickle.register_pickle_by_value(curve_search)  # the helper travels with the task; executors need no installed package

MIN_POINTS = 6


def series_arrays(panel: DataFrame, value: str = "actual", keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """One row per key: `series`, the values in order of t. Bounded by the number of months.

    The explicit repartition keeps the parallelism of the costly steps that follow; the grouping reuses it.
    """
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("y"))))
    return panel.where(F.col(value).isNotNull()).repartition(parts, *keys).groupBy(*keys).agg(ordered.alias("_s")).select(
        *keys, F.transform("_s", lambda p: p["y"]).alias("series"))


def usable_series(arrays: DataFrame, min_points: int = MIN_POINTS) -> tuple[DataFrame, DataFrame]:
    """(series with enough finite, strictly positive points; the others)."""
    good = (F.size("series") >= min_points) & F.forall(
        "series", lambda y: (y > 0) & ~F.isnan(y) & (y < float("inf")))
    return arrays.where(good), arrays.where(~good)


def fit_series(arrays: DataFrame, series: str = "series", zooms: int = 2) -> DataFrame:
    """Adds qi, di, b to every row with a series; row-local."""
    @F.pandas_udf("qi double, di double, b double")
    def search(s: pd.Series) -> pd.DataFrame:
        return fit_batch(s, zooms)

    return arrays.withColumn("_fit", search(series)).withColumns(
        {c: F.col(f"_fit.{c}") for c in ("qi", "di", "b")}).drop("_fit")


def fit_decline(panel: DataFrame, value: str = "actual", keys: Sequence[str] = ("asset_id",), zooms: int = 2,
                min_points: int = MIN_POINTS) -> DataFrame:
    """(keys, n, series, qi, di, b) for every usable asset."""
    good, _ = usable_series(series_arrays(panel, value, keys), min_points)
    return fit_series(good, zooms=zooms).withColumn("n", F.size("series"))


def fit_quality(fits: DataFrame, series: str = "series") -> DataFrame:
    """Adds r_squared, mae, confidence, residual statistics and the low-fit flag; row-local."""
    y = F.col(series)
    n = F.size(series).cast("double")
    resid = F.transform(y, lambda v, i: v - hyperbolic_rate(F.col("qi"), F.col("di"), F.col("b"), i.cast("double")))
    held = fits.withColumns({"_r": resid, "_mean": F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / n})
    held = held.withColumns({
        "_res": F.aggregate("_r", F.lit(0.0), lambda a, v: a + v * v),
        "_tot": F.aggregate(y, F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))),
        "residual_mean": F.aggregate("_r", F.lit(0.0), lambda a, v: a + v) / n,
        "mae": F.aggregate("_r", F.lit(0.0), lambda a, v: a + F.abs(v)) / n,
        "residual_max_abs": F.array_max(F.transform("_r", lambda v: F.abs(v)))})
    tot = F.when(F.col("_tot") == 0, 1e-9).otherwise(F.col("_tot"))
    held = held.withColumn("r_squared", clamp(1.0 - F.col("_res") / tot, 0, 1))
    return held.withColumns({
        "confidence": clamp(F.col("r_squared") * 0.99, 0, 0.99),
        "residual_std": F.sqrt(F.greatest(F.col("_res") / n - F.col("residual_mean") * F.col("residual_mean"), F.lit(0.0))),
        "bias_pct": F.col("residual_mean") / F.greatest(F.col("_mean"), F.lit(1e-9)) * 100.0,
        "low_fit": F.col("r_squared") < 0.80,
    }).drop("_r", "_mean", "_res", "_tot")


def nominal_decline(di: Column, b: Column, t: Column) -> Column:
    di, b, t = clamp(di, DI_MIN, DI_MAX), clamp(b, B_MIN, B_MAX), F.greatest(t, F.lit(0.0))
    return di / (1.0 + b * di * t)


def effective_annual_pct(di: Column, b: Column, t: Column) -> Column:
    cd, cb, ct = clamp(di, DI_MIN, DI_MAX), clamp(b, B_MIN, B_MAX), F.greatest(t, F.lit(0.0))
    ratio = F.when(cb < 1e-4, F.exp(-12.0 * nominal_decline(di, b, t))).otherwise(
        F.pow((1.0 + cb * cd * ct) / (1.0 + cb * cd * (ct + 12.0)), 1.0 / F.when(cb < 1e-4, 1.0).otherwise(cb)))
    return clamp((1.0 - ratio) * 100.0, 1e-6, 99.999)


def decline_report(df: DataFrame, t: Column) -> DataFrame:
    """Adds the nominal monthly and effective yearly decline at time t."""
    nominal = nominal_decline(F.col("di"), F.col("b"), t)
    return df.withColumns({
        "nominal_decline_per_month": F.round(nominal, 6), "decline_pct_per_month": F.round(nominal * 100.0, 4),
        "effective_decline_pct_per_year": F.round(effective_annual_pct(F.col("di"), F.col("b"), t), 3)})


def horizon_rates(fits: DataFrame, last_t: Column) -> DataFrame:
    """Adds the modelled rate 30/90/180/365 days after the last point and the current decline."""
    rates = {f"rate_{d}d": hyperbolic_rate(F.col("qi"), F.col("di"), F.col("b"), last_t + F.lit(d / DAYS_PER_MONTH))
             for d in HORIZON_DAYS}
    current = clamp(F.round(nominal_decline(F.col("di"), F.col("b"), last_t) * 100.0, 4), 0.0, 19.999)
    return fits.withColumns({**rates, "current_decline_pct": current})


def fit_decline_grid(panel: DataFrame, value: str = "actual", keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Coarse grid over (qi, di, b), then a fine grid around its best cell; t starts at one."""
    @F.pandas_udf("qi double, di double, b double, sse double")
    def search(s: pd.Series) -> pd.DataFrame:
        return grid_batch(s)

    good, _ = usable_series(series_arrays(panel, value, keys), 12)
    y = F.col("series")
    held = good.withColumn("_w", search("series")).withColumns({c: F.col(f"_w.{c}") for c in ("qi", "di", "b", "sse")})
    n = F.size("series").cast("double")
    mean = F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / n
    held = held.withColumns({"n": F.size("series"), "_mean": mean})
    tot = F.aggregate(y, F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean")))
    err = F.aggregate(F.transform(y, lambda v, i: F.abs(v - hyperbolic_rate(
        F.col("qi"), F.col("di"), F.col("b"), (i + 1).cast("double"), eps=1e-3))), F.lit(0.0), lambda a, v: a + v)
    rate = {f"rate_{d}d": hyperbolic_rate(F.col("qi"), F.col("di"), F.col("b"), F.lit(float(m)), eps=1e-3)
            for d, m in ((30, 1), (90, 3), (180, 6))}
    return held.withColumns({
        "r_squared": F.when(tot == 0, 0.0).otherwise(1.0 - F.col("sse") / F.nullif(tot, F.lit(0.0))),
        "mae": err / n, "std_error": F.sqrt(F.greatest(F.col("sse") / (n - 3), F.lit(0.0))), **rate,
    }).drop("_w", "_mean")


def fitted_curve(fits: DataFrame, keys: Sequence[str] = ("asset_id",), start: int = 0, eps: float = 1e-4) -> DataFrame:
    """One row per month: month number and modelled rate."""
    months = fits.select(*keys, "qi", "di", "b", F.posexplode("series").alias("_i", "observed"))
    month = (F.col("_i") + start).cast("int")
    return months.select(*keys, month.alias("month"), "observed", hyperbolic_rate(
        F.col("qi"), F.col("di"), F.col("b"), month.cast("double"), eps).alias("fitted"))


def forecast_decline(fits: DataFrame, months: int, keys: Sequence[str] = ("asset_id",), eps: float = 1e-3) -> DataFrame:
    """The curve for months 1..n."""
    ahead = fits.select(*keys, "qi", "di", "b", F.explode(F.sequence(F.lit(1), F.lit(int(months)))).alias("month"))
    return ahead.select(*keys, "month", hyperbolic_rate(
        F.col("qi"), F.col("di"), F.col("b"), F.col("month").cast("double"), eps).alias("rate"))


def expected_series(panel: DataFrame, params: DataFrame, month_factors: Sequence[float] | None = None,
                    value: str = "actual", own_fit: bool = True) -> DataFrame:
    """Adds `expected`: catalogue decline at t times the month factor; an asset without parameters gets its own fit,
    and its actual values when it has too few points for one."""
    known = panel.join(params.select("asset_id", "qi", "di", "b"), "asset_id", "left")
    t = F.col("t").cast("double")
    factor = F.lit(1.0)
    if month_factors is not None:
        factor = F.element_at(F.array(*[F.lit(float(v)) for v in month_factors]), F.month("period"))
    from_params = hyperbolic_rate(F.col("qi"), F.col("di"), F.col("b"), t) * factor
    if not own_fit:
        return known.withColumn("expected", from_params).drop("qi", "di", "b")
    lacking = panel.join(params.select("asset_id"), "asset_id", "left_anti")
    fits = fit_decline(lacking, value).select(
        "asset_id", F.col("qi").alias("_q"), F.col("di").alias("_d"), F.col("b").alias("_b"))
    own = hyperbolic_rate(F.col("_q"), F.col("_d"), F.col("_b"), t)
    return known.join(fits, "asset_id", "left").withColumn(
        "expected", F.coalesce(from_params, own, F.col(value))).drop("qi", "di", "b", "_q", "_d", "_b")
