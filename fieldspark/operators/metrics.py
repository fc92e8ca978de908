"""Model metrics, grouped by any keys. Everything is a mergeable aggregate; ranks come from pre-aggregated scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import clamp
from fieldspark.operators.quantiles import group_percentiles


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def regression_aggs(y: str, yhat: str, zero_spread: Column | None = None) -> list[Column]:
    """zero_spread: what to divide by in R2 when the actual values do not vary (NULL R2 by default)."""
    err = F.col(yhat) - F.col(y)
    n = F.count(err)
    res, tot = F.sum(err * err), F.var_pop(y) * n
    r2 = (1.0 - F.try_divide(res, tot)) if zero_spread is None else 1.0 - res / F.when(tot == 0, zero_spread).otherwise(tot)
    return [
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), r2.alias("r2"),
        (F.avg(F.abs(err) / F.greatest(F.abs(F.col(y)), F.lit(1e-9))) * 100.0).alias("mape"),
        F.max(F.abs(err)).alias("max_error"), F.avg(-err).alias("mean_error"), n.alias("n")]


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by).agg(*regression_aggs(y, yhat))


_CONFUSION = ("tp", "fp", "fn", "tn")


def _ranked_sums(df: DataFrame, label: Column, score: Column, by: list[str], counts: Sequence[Column], names: Sequence[str],
                 bins: int, lo: float, hi: float) -> DataFrame:
    """One row per group: the named counts and `roc_auc`, in a single chain of aggregates.

    Equal scores collapse to one row in the map tasks. Negatives below a score are counted inside one coarse score bin
    first and over the bins of a group second, so no task orders a whole group.
    """
    place = F.floor(clamp((score - lo) / (hi - lo), 0, 1) * (bins - 1)).cast("int")
    value = df.where(score.isNotNull() & label.isNotNull()).groupBy(*by, place.alias("_bin"), score.alias("_v")).agg(
        F.count_if(label).alias("_p"), F.count_if(~label).alias("_n"), *[c.alias(n) for c, n in zip(counts, names)])
    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    value = value.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    per_bin = value.groupBy(*by, "_bin").agg(
        F.sum(F.col("_p") * (F.col("_below") + 0.5 * F.col("_n"))).alias("_u"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"),
        *[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(before), F.lit(0)))
    pairs = F.sum("_p").cast("double") * F.sum("_n")
    return per_bin.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum("_u"), pairs), F.lit(0.5)).alias("roc_auc"), *[F.sum(n).alias(n) for n in names])


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int = 4096, lo: float = 0.0,
        hi: float = 1.0) -> DataFrame:
    """Rank-sum ROC-AUC with average ranks for ties; 0.5 when a class is absent. Bins only steer parallelism."""
    return _ranked_sums(df, F.col(label), F.col(score), list(by), [], [], bins, lo, hi)


def classification_metrics(df: DataFrame, label: str, pred: str, score: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy, FPR and, with a score, ROC-AUC; one pass over the rows."""
    by = list(by)
    y, p = F.col(label), F.col(pred)
    counts = [F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p), F.count_if(~y & ~p)]
    if score is None:
        out = df.groupBy(*by).agg(*[c.alias(n) for c, n in zip(counts, _CONFUSION)])
    else:
        out = _ranked_sums(df, y, F.col(score), by, counts, _CONFUSION, 4096, 0.0, 1.0)
    tp, fp, fn, tn = (F.col(c) for c in _CONFUSION)
    return out.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "false_positive_rate": _ratio(fp, fp + tn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "n": tp + fp + fn + tn})


def forecast_accuracy(df: DataFrame, y: str, yhat: str, step: str = "step", by: Sequence[str] = (),
                      horizons: Mapping[int, int] | None = None) -> DataFrame:
    """Regression metrics over the first m steps for each horizon (days -> months); groups with fewer steps drop out.

    A step belongs to every horizon that reaches it, so rows are tagged with at most three horizons, without a join.
    """
    by = list(by)
    horizons = horizons or {30: 1, 90: 3, 180: 6}
    listed = F.array(*[F.struct(F.lit(d).alias("days"), F.lit(m).alias("m")) for d, m in horizons.items()])
    tagged = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).select(
        "*", F.explode(F.filter(listed, lambda h: h["m"] >= F.col(step))).alias("h"))
    out = tagged.groupBy(*by, F.col("h.days").alias("horizon_days")).agg(
        *regression_aggs(y, yhat), F.max("h.m").alias("_m"), F.countDistinct(step).alias("_steps"))
    return out.where(F.col("_steps") >= F.col("_m")).drop("_m", "_steps")


def residual_stats(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), exact: str = "bracket") -> DataFrame:
    rows = df.withColumn("_e", F.col(y) - F.col(yhat)).where(F.col("_e").isNotNull())
    return group_percentiles(
        rows, list(by), "_e", {"median": 0.5, "q25": 0.25, "q75": 0.75}, exact,
        extra=[F.avg("_e").alias("mean"), F.stddev_pop("_e").alias("std"), F.min("_e").alias("min"), F.max("_e").alias("max")])


def bias_stats(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), exact: str = "bracket") -> DataFrame:
    rows = df.withColumn("_b", (F.col(yhat) - F.col(y)) / F.greatest(F.col(y), F.lit(1e-9)) * 100.0).where(F.col("_b").isNotNull())
    n = F.count("_b")
    out = group_percentiles(
        rows, list(by), "_b", {"median_bias_pct": 0.5}, exact,
        extra=[F.avg("_b").alias("mean_bias_pct"), (F.count_if(F.col("_b") > 0) / n * 100.0).alias("positive_bias_pct"),
               (F.count_if(F.col("_b") < 0) / n * 100.0).alias("negative_bias_pct")])
    return out


def portfolio_forecast_metrics(per_asset: DataFrame) -> DataFrame:
    """Mean of per-asset metrics by horizon and overall (horizon NULL), four decimals."""
    return per_asset.groupBy("horizon_days").agg(
        *[F.round(F.avg(c), 4).alias(c) for c in ("mae", "rmse", "r2", "mape")], F.countDistinct("asset_id").alias("assets"))


def portfolio_anomaly_metrics(per_asset: DataFrame) -> DataFrame:
    return per_asset.agg(
        *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1", "roc_auc", "accuracy")],
        F.sum("n").alias("sample_count"), F.count(F.lit(1)).alias("assets"))


def to_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric_name", "metric_value")


def metric_status(long: DataFrame, targets: Mapping[str, tuple[str, float]]) -> DataFrame:
    """PASS or FAIL against targets: metric -> ('<' or '>', bound). Metrics without a target are dropped."""
    met = None
    bound = None
    for name, (op, value) in targets.items():
        here = F.col("metric_name") == name
        test = F.col("metric_value") < value if op == "<" else F.col("metric_value") > value
        met = F.when(here, test) if met is None else met.when(here, test)
        bound = F.when(here, F.lit(float(value))) if bound is None else bound.when(here, F.lit(float(value)))
    return long.where(F.col("metric_name").isin(*targets)).withColumns({
        "target": bound, "status": F.when(met, "PASS").otherwise("FAIL")})
