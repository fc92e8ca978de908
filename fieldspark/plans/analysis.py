"""The whole analysis of every asset as one job: no loop over assets, no per-asset query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.config import ForecastConfig, ForestConfig, ScoreConfig
from fieldspark.functions.boosting import BoostConfig
from fieldspark.operators import anomaly, decline, forecast, portfolio, scoring
from fieldspark.session import cut_lineage

DIMS = ("field_name", "basin", "status", "onstream_year", "intervention_cost")


def analyze(
    panel: DataFrame, assets: DataFrame, month_factors: Sequence[float] | None = None, base: str = "persistence",
    months: int = 12, trees: int = 300, forest: ForestConfig = ForestConfig(), config: ScoreConfig = ScoreConfig(),
    fc: ForecastConfig = ForecastConfig(), provenance: DataFrame | None = None, origins: Sequence[int] | None = None,
) -> DataFrame:
    """One wide row per asset: decline fit, anomaly state, forecast, backtest, recovery, score, recommendations, rank.

    The monthly panel feeds every branch and is pinned once; the branches meet on the asset, one row each. `base` is the
    forecaster: "persistence" or "gbt", a boosted model of each asset, of which `importance` lists the strongest features; the
    backtest is of the same forecaster. The boosted models are refitted at `origins` (month numbers); by default at every sixth
    month of each asset's own last third. Assets with too few months for a forest, fit or backtest keep their row, with NULL in
    what could not be computed.
    """
    panel = cut_lineage(panel.select("asset_id", "period", "t", "actual"))
    fits = decline.fit_quality(decline.fit_decline(panel))
    fits = decline.horizon_rates(fits, (F.col("n") - 1).cast("double"))
    fits = cut_lineage(fits.select(
        "asset_id", "n", "series", "qi", "di", "b", "r_squared", "mae", "confidence", "low_fit", "current_decline_pct",
        *[f"rate_{d}d" for d in (30, 90, 180, 365)]))

    expected = decline.expected_series(panel, assets, month_factors)
    scored = cut_lineage(anomaly.detector_scores(expected, forest))
    windows = anomaly.detect_windows(scored)
    evaluation = anomaly.evaluate_detector(scored).select(
        "asset_id", F.struct("precision", "recall", "f1", "roc_auc", "accuracy", "n").alias("detector_metrics"))
    listed = panel.select("asset_id").distinct()
    latest = listed.join(portfolio.latest_state(scored), "asset_id", "left")
    state = portfolio.score_assets(latest, assets.select("asset_id", *DIMS), config)

    params = fits.select("asset_id", "series", "qi", "di", "b")
    if base == "gbt":
        rolled = forecast.boosted_paths(params, months, 12, boost=BoostConfig(trees=trees), config=fc)
        rolled = rolled.withColumn("importance", forecast.strongest(F.col("importance")))
    else:
        sigma = forecast.persistence_residuals(panel, warmup=fc.warmup)
        rolled = forecast.rollout(params, months, config=fc).join(sigma, "asset_id", "left")
    own = [c for c in ("residual_std", "importance") if c in rolled.columns]
    ahead = rolled.select("asset_id", "path", *own, *[
        F.get("path", F.lit(forecast.months_of(d) - 1)).alias(f"forecast_{d}d") for d in (30, 90, 180, 365)])
    if base == "gbt":
        pairs = forecast.backtest_model(panel, origins, trees=trees, config=fc)
    else:
        pairs = forecast.backtest_pairs(panel, config=fc)
    metrics = cut_lineage(forecast.backtest_metrics(pairs))
    figures = ("mae", "rmse", "r2", "mape", "folds")
    errors = metrics.groupBy("asset_id").agg(
        F.max(F.when(F.col("horizon_days").isNull(), F.struct(*figures))).alias("backtest"),
        F.sort_array(F.collect_list(F.when(F.col("horizon_days").isNotNull(), F.struct("horizon_days", *figures)))).alias("backtest_horizons"))

    out = state.join(fits.drop("series"), "asset_id", "left").join(ahead, "asset_id", "left")
    out = out.join(errors, "asset_id", "left").join(evaluation, "asset_id", "left")
    out = out.join(anomaly.recent_windows(windows).select("asset_id", "windows"), "asset_id", "left")
    out = out.withColumn("contributing_features", anomaly.contributions(F.col("flagged_dev_fraction"), F.col("flagged_change_rate")))
    out = scoring.verification_codes(out.withColumn("top_feature", F.col("contributing_features")[0]["feature"])).drop("top_feature")
    if provenance is not None:
        out = out.join(provenance, "asset_id", "left")
    # only asset and score are sorted and pinned for the rank; the wide rows are computed once, by the caller's action
    ranks = portfolio.rank_assets(state.select("asset_id", "score")).drop("score")
    return out.join(ranks, "asset_id")
