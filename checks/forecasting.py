"""Forecast, backtest, metric and attribution queries."""

from pyspark.sql import functions as F

from checks.base import ASSETS, MONTHLY, query, rounded, with_
from checks.features import FCOLS, FF, RATE, forecast_rows
from checks.scoring import AF
from fieldspark.config import ForecastConfig
from fieldspark.operators import attribution as at
from fieldspark.operators import decline, features, forecast, metrics
from fieldspark.plans import bindings as b
from fieldspark.session import cut_lineage
from fieldspark.sources import sinks

META = ("intervention_cost", "onstream_year")
PARAMS = ("asset_id", "qi", "di", "b")
STEP = RATE.format(b="b", qi="qi", di="di", t="(n + k)")  # k steps done: the next one is month n + k


def panel_with_params(spark, sf):
    return b.monthly(spark, sf).join(b.assets(spark, sf).select(*PARAMS), "asset_id")


def _roll_sql(months: str, count: int, start: str) -> str:
    """Recursive CTE `roll` from a CTE `start` (ids.., n, prev, qi, di, b, months)."""
    w = f"least(0.35::DOUBLE * least((k + 1) / greatest({months} / 2::DOUBLE, 1), 1.5::DOUBLE), 0.7::DOUBLE)"
    return f"""
, roll AS (SELECT *, 0 AS k, prev AS forecast FROM {start}
  UNION ALL SELECT * EXCLUDE (k, forecast), k + 1, greatest((1 - {w}) * forecast + {w} * ({STEP}), 0.01::DOUBLE) FROM roll WHERE k < {count})"""


ROLL = with_(MONTHLY, ASSETS).replace("WITH ", "WITH RECURSIVE ", 1) + """
, st AS (SELECT asset_id, n, prev, qi, di, b, sd FROM (SELECT asset_id, count(*) AS n, arg_max(actual, t) AS prev FROM monthly GROUP BY 1) x
   JOIN assets USING (asset_id) JOIN (SELECT asset_id, stddev_pop(actual - lagged) FILTER (WHERE t >= 13) AS sd FROM
   (SELECT asset_id, t, actual, lag(actual) OVER (PARTITION BY asset_id ORDER BY t) AS lagged FROM monthly) y GROUP BY 1) z USING (asset_id))""" + _roll_sql("12", 12, "st") + """
, pts AS (SELECT asset_id, k AS step, CAST(round(k * 30.4375::DOUBLE) AS INTEGER) AS day, forecast,
   greatest(forecast - 1.28::DOUBLE * sd * (1 + 0.15::DOUBLE * sqrt(k)), 0) AS lower, forecast + 1.28::DOUBLE * sd * (1 + 0.15::DOUBLE * sqrt(k)) AS upper, sd FROM roll WHERE k > 0)"""


def points(spark, sf):
    panel = panel_with_params(spark, sf)
    state = decline.series_arrays(panel, keys=PARAMS)
    sigma = forecast.persistence_residuals(b.monthly(spark, sf))
    return forecast.forecast_points(forecast.rollout(state, 12).join(sigma, "asset_id"))


@query("rollout_persistence", sql=ROLL + """
SELECT asset_id, step, day, round(forecast, 6) AS forecast, round(lower, 6) AS lower, round(upper, 6) AS upper FROM pts""")
def rollout_persistence(spark, sf):
    return rounded(points(spark, sf).drop("residual_std"))


@query("horizon_summary", sql=ROLL + " SELECT asset_id, " + ", ".join(
    f"round(max(forecast) FILTER (WHERE step = {m}), 6) AS forecast_{d}d" for d, m in ((30, 1), (90, 3), (180, 6), (365, 12))) + " FROM pts GROUP BY 1")
def horizon_summary(spark, sf):
    return rounded(forecast.horizon_summary(points(spark, sf)))


@query("forecast_slice", sql=ROLL + " SELECT asset_id, step, round(forecast, 6) AS forecast FROM pts WHERE step <= 3")
def forecast_slice(spark, sf):
    return rounded(forecast.forecast_slice(points(spark, sf), 90).select("asset_id", "step", "forecast"))


@query("residual_std", sql=ROLL + " SELECT asset_id, round(sd, 6) AS residual_std FROM st")
def residual_std(spark, sf):
    return rounded(forecast.persistence_residuals(b.monthly(spark, sf)))


@query("forecast_fact_rows", sql=ROLL + """
SELECT asset_id, step, round(forecast, 6) AS forecast_value, CAST(last_p + to_months(step) AS DATE) AS forecast_date,
  round(least(greatest(1 - sd / greatest(forecast, 1e-9), 0.3::DOUBLE), 0.95::DOUBLE), 6) AS confidence FROM pts
  JOIN (SELECT asset_id, max(period) AS last_p FROM monthly GROUP BY 1) l USING (asset_id)""")
def forecast_fact_rows(spark, sf):
    last = b.monthly(spark, sf).groupBy("asset_id").agg(F.max("period").alias("last_period"))
    out = sinks.forecast_rows(points(spark, sf).join(last, "asset_id"))
    return rounded(out.select("asset_id", "step", "forecast_value", "forecast_date", "confidence"))


@query("forecast_view", sql=ROLL + """
SELECT asset_id, period, 'history' AS kind, round(actual, 6) AS value FROM monthly QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY t DESC) <= 12
UNION ALL SELECT asset_id, CAST(last_p + to_months(step) AS DATE), 'forecast', round(forecast, 6) FROM pts
  JOIN (SELECT asset_id, max(period) AS last_p FROM monthly GROUP BY 1) l USING (asset_id)""")
def forecast_view(spark, sf):
    return rounded(forecast.forecast_view(b.monthly(spark, sf), points(spark, sf)).select("asset_id", "period", "kind", "value"))


BT = with_(MONTHLY, ASSETS).replace("WITH ", "WITH RECURSIVE ", 1) + """
, sz AS (SELECT asset_id, count(*) AS total FROM monthly GROUP BY 1)
, cuts AS (SELECT asset_id, total, unnest(range(greatest(14, CAST(floor(total * 0.66::DOUBLE) AS BIGINT)), total)) AS n FROM sz)
, st AS (SELECT c.asset_id, c.n, m.actual AS prev, qi, di, b, least(greatest(total - c.n, 6), 12) AS months FROM cuts c
   JOIN monthly m ON m.asset_id = c.asset_id AND m.t = c.n - 1 JOIN assets a ON a.asset_id = c.asset_id)""" + _roll_sql("months", 6, "st") + """
, pairs AS (SELECT r.asset_id, r.n AS cut, CASE k WHEN 1 THEN 30 WHEN 3 THEN 90 ELSE 180 END AS horizon_days, m.actual, r.forecast AS predicted
   FROM roll r JOIN monthly m ON m.asset_id = r.asset_id AND m.t = r.n + r.k - 1 WHERE k IN (1, 3, 6))
, bm AS (SELECT asset_id, horizon_days, avg(abs(predicted - actual)) AS mae, sqrt(avg(power(predicted - actual, 2))) AS rmse,
   1 - sum(power(predicted - actual, 2)) / CASE WHEN var_pop(actual) = 0 THEN 1 ELSE var_pop(actual) * count(*) END AS r2,
   avg(abs(predicted - actual) / greatest(abs(actual), 1e-9)) * 100 AS mape, count(*) AS folds
  FROM pairs GROUP BY GROUPING SETS ((asset_id, horizon_days), (asset_id)))"""


def pairs(spark, sf):
    return forecast.backtest_pairs(panel_with_params(spark, sf), refit=False)


@query("backtest_pairs", sql=BT + """
SELECT asset_id, CAST(cut AS INTEGER) AS cut, horizon_days, actual, round(predicted, 6) AS predicted FROM pairs""")
def backtest_pairs(spark, sf):
    return rounded(pairs(spark, sf))


@query("backtest_persistence", sql=BT + """
SELECT asset_id, horizon_days, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(r2, 5) AS r2, round(mape, 5) AS mape, folds FROM bm""")
def backtest_persistence(spark, sf):
    return rounded(forecast.backtest_metrics(pairs(spark, sf)), 5)


@query("portfolio_forecast_metrics", sql=BT + """
SELECT horizon_days, round(avg(mae), 4) AS mae, round(avg(rmse), 4) AS rmse, round(avg(r2), 4) AS r2, round(avg(mape), 4) AS mape, count(DISTINCT asset_id) AS assets FROM bm GROUP BY 1""")
def portfolio_forecast_metrics(spark, sf):
    return metrics.portfolio_forecast_metrics(forecast.backtest_metrics(pairs(spark, sf)))


@query("backtest_refit")
def backtest_refit(spark, sf):
    """Decline parameters refitted at every origin from the months before it."""
    return rounded(forecast.backtest_metrics(forecast.backtest_pairs(b.monthly(spark, sf))), 4)


def gbt(spark, sf):
    panel = b.monthly(spark, sf).drop("expected").join(b.assets(spark, sf), "asset_id")
    rows = cut_lineage(forecast.training_rows(panel, metadata=META))  # read by the fit, the residuals and the ablation
    return panel, rows, forecast.fit_forecaster(rows)


@query("forecast_gbt")
def forecast_gbt(spark, sf):
    panel, rows, model = gbt(spark, sf)
    sigma = forecast.residual_std(forecast.predict_rows(model, rows))
    scale = rows.groupBy("asset_id").agg(F.max("scale").alias("scale"))
    state = decline.series_arrays(panel, keys=(*PARAMS, *META)).join(scale, "asset_id").join(sigma, "asset_id")
    return rounded(forecast.forecast_points(forecast.rollout(state, 12, forecast.model_step(model, META))), 4)


@query("backtest_gbt")
def backtest_gbt(spark, sf):
    """Every month of each asset's own last third is an origin with a fit of the library's default size."""
    panel = b.monthly(spark, sf).drop("expected").join(b.assets(spark, sf), "asset_id")
    return rounded(forecast.backtest_metrics(forecast.backtest_model(panel, metadata=META, stride=1), ()), 4)


@query("feature_importance")
def feature_importance(spark, sf):
    return rounded(forecast.feature_importance(gbt(spark, sf)[2], spark, META), 6)


COEF = (0.4, 0.15, 0.1, 0.05, 0.1, 0.1, 0.1, -0.2, 3.0, 0.5, 2.0, -1.0, 0.05, 0.3, 0.01)
NAMES = list(FCOLS)


def contributions(spark, sf, size=None):
    rows, _ = features.supervised_matrix(forecast_rows(spark, sf))
    rows = rows.select("asset_id", "t", F.array(*[F.col(c).cast("double") for c in NAMES]).alias("features"))
    return at.ablation_contributions(at.last_rows(rows), at.background_rows(rows, size), NAMES, at.linear_predict(COEF))


MEANS = ", ".join(f"avg({c}) AS m_{c}" for c in NAMES)
ABL = with_(MONTHLY, ASSETS) + FF + f"""
, sup AS (SELECT * FROM ff WHERE t >= 13 QUALIFY count(*) OVER (PARTITION BY asset_id) >= 8)
, bg AS (SELECT * FROM sup QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY md5(concat_ws(':', '42', asset_id, t::VARCHAR)), t) <= 64)
, bm AS (SELECT asset_id, {MEANS} FROM bg GROUP BY 1)
, li AS (SELECT * FROM sup QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY t DESC) = 1)
, base AS (SELECT asset_id, {' + '.join(f'{c!r}::DOUBLE * m_{n}' for c, n in zip(COEF, NAMES))} AS base FROM bm)
, con AS (""" + " UNION ALL ".join(
    f"SELECT asset_id, '{n}' AS feature, {n}::DOUBLE AS value, {c!r}::DOUBLE * ({n} - m_{n}) AS contribution FROM li JOIN bm USING (asset_id)"
    for c, n in zip(COEF, NAMES)) + """)
, ct AS (SELECT *, abs(contribution) / sum(abs(contribution)) OVER (PARTITION BY asset_id) * 100 AS share_pct FROM con JOIN base USING (asset_id))
, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY round(share_pct, 9) DESC, feature) AS INTEGER) AS rank FROM ct QUALIFY rank <= 6)"""


ABLATION = """
SELECT asset_id, feature, round(value, 9) + 0.0::DOUBLE AS value, round(base, 9) AS base, round(contribution, 9) + 0.0::DOUBLE AS contribution FROM con JOIN base USING (asset_id)"""
RANKED = """
SELECT asset_id, feature, rank, round(share_pct, 5) AS share_pct, CASE WHEN contribution >= 0 THEN 'UPWARD' ELSE 'DOWNWARD' END AS direction FROM top"""
STEPS = """
, w AS (SELECT asset_id, rank, contribution, base + sum(contribution) OVER (PARTITION BY asset_id ORDER BY rank) AS end_value FROM top)
SELECT asset_id, rank, round(end_value - contribution, 5) AS start, round(end_value, 5) AS "end" FROM w"""
LEAD = """
, last_m AS (SELECT * FROM monthly QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY t DESC) = 1)
SELECT asset_id, l.period, round(l.actual - l.expected, 5) + 0.0::DOUBLE AS gap_signed, top.feature AS lead_feature, round(share_pct, 5) AS lead_share
FROM last_m l JOIN top USING (asset_id) WHERE rank = 1"""
# The SQL of the first four is defined on a background of 64 rows an asset, so they ask for that sample. The _all queries are
# the whole job: every month of the asset is background, as the library sets it.
SAMPLED = 64
ABL_ALL = ABL.replace(" QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY md5(concat_ws(':', '42', asset_id, t::VARCHAR)), t) <= 64", "")


def _ranked(spark, sf, size=None):
    return rounded(at.contribution_table(contributions(spark, sf, size)).select("asset_id", "feature", "rank", "share_pct", "direction"), 5)


def _steps(spark, sf, size=None):
    return rounded(at.waterfall(at.contribution_table(contributions(spark, sf, size))).select("asset_id", "rank", "start", "end"), 5)


def _lead(spark, sf, size=None):
    state = at.last_rows(b.monthly(spark, sf))
    out = at.attribute_deviation(state, at.contribution_table(contributions(spark, sf, size)))
    first = F.col("contributions")[0]
    return rounded(out.select("asset_id", "period", "gap_signed", first["feature"].alias("lead_feature"), first["share_pct"].alias("lead_share")), 5)


@query("ablation_linear", sql=ABL + ABLATION)
def ablation_linear(spark, sf):
    return rounded(contributions(spark, sf, SAMPLED), 9)


@query("contribution_table", sql=ABL + RANKED)
def contribution_table(spark, sf):
    return _ranked(spark, sf, SAMPLED)


@query("waterfall", sql=ABL + STEPS)
def waterfall(spark, sf):
    return _steps(spark, sf, SAMPLED)


@query("attribute_deviation", sql=ABL + LEAD)
def attribute_deviation(spark, sf):
    return _lead(spark, sf, SAMPLED)


@query("ablation_linear_all", sql=ABL_ALL + ABLATION)
def ablation_linear_all(spark, sf):
    return rounded(contributions(spark, sf), 9)


@query("contribution_table_all", sql=ABL_ALL + RANKED)
def contribution_table_all(spark, sf):
    return _ranked(spark, sf)


@query("waterfall_all", sql=ABL_ALL + STEPS)
def waterfall_all(spark, sf):
    return _steps(spark, sf)


@query("attribute_deviation_all", sql=ABL_ALL + LEAD)
def attribute_deviation_all(spark, sf):
    return _lead(spark, sf)


@query("ablation_gbt")
def ablation_gbt(spark, sf):
    _, rows, model = gbt(spark, sf)
    names = forecast.feature_names(META)
    out = at.ablation_contributions(at.last_rows(rows), at.background_rows(rows), names, at.model_predict(model))
    labelled = at.contribution_table(out).withColumn("label", forecast.feature_label(F.col("feature")))
    return rounded(labelled.select("asset_id", "rank", "feature", "label", "direction", "share_pct"), 4)


REG = """avg(abs(expected - actual)) AS mae, sqrt(avg(power(expected - actual, 2))) AS rmse,
  1 - sum(power(expected - actual, 2)) / (var_pop(actual) * count(*)) AS r2, avg(abs(expected - actual) / greatest(abs(actual), 1e-9)) * 100 AS mape,
  max(abs(expected - actual)) AS max_error, avg(actual - expected) AS mean_error, count(*) AS n"""
REGR = ", ".join(f"round({c}, 5) + 0.0::DOUBLE AS {c}" for c in ("mae", "rmse", "r2", "mape", "max_error", "mean_error"))


@query("regression_metrics", sql=with_(MONTHLY) + f", g AS (SELECT asset_id, {REG} FROM monthly WHERE expected IS NOT NULL GROUP BY 1) SELECT asset_id, {REGR}, n FROM g")
def regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(b.monthly(spark, sf), "actual", "expected", ["asset_id"]), 5)


LAB = AF + """
, lab AS (SELECT asset_id, least(abs(change_rate), 1) AS s, abs(dev_fraction) >= 0.1::DOUBLE AS y FROM af)"""
CLS = """count(*) FILTER (WHERE y AND s >= 0.3::DOUBLE) AS tp, count(*) FILTER (WHERE NOT y AND s >= 0.3::DOUBLE) AS fp,
 count(*) FILTER (WHERE y AND s < 0.3::DOUBLE) AS fn, count(*) FILTER (WHERE NOT y AND s < 0.3::DOUBLE) AS tn"""
RANKS = """, rk AS (SELECT *, rank() OVER ({p} ORDER BY s) + (count(*) OVER ({p2} s) - 1) / 2::DOUBLE AS r FROM lab)"""


def labelled(spark, sf):
    f = features.anomaly_features(b.monthly(spark, sf))
    s = F.least(F.abs("change_rate"), F.lit(1.0))
    return f.select("asset_id", s.alias("s"), (F.abs("dev_fraction") >= 0.1).alias("y"), (s >= 0.3).alias("p"))


@query("classification_metrics", sql=with_(MONTHLY) + LAB + RANKS.format(p="", p2="PARTITION BY") + f"""
, c AS (SELECT {CLS}, (sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2::DOUBLE) / (count(*) FILTER (WHERE y))::DOUBLE / count(*) FILTER (WHERE NOT y) AS roc_auc FROM rk)
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1,
 round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(fp / (fp + tn)::DOUBLE, 6) AS false_positive_rate, round(roc_auc, 6) AS roc_auc, tp + fp + fn + tn AS n FROM c""")
def classification_metrics(spark, sf):
    return rounded(metrics.classification_metrics(labelled(spark, sf), "y", "p", "s"))


@query("auc_rank_sum", sql=with_(MONTHLY) + LAB + RANKS.format(p="PARTITION BY asset_id", p2="PARTITION BY asset_id,") + """
SELECT asset_id, round(coalesce((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2::DOUBLE) / nullif(count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y), 0)::DOUBLE, 0.5), 6) AS roc_auc
FROM rk GROUP BY 1""")
def auc_rank_sum(spark, sf):
    return rounded(metrics.auc(labelled(spark, sf), "y", "s", ["asset_id"]))


@query("residual_stats", sql=with_(MONTHLY) + """
, e AS (SELECT asset_id, actual - expected AS e FROM monthly WHERE expected IS NOT NULL)
SELECT asset_id, count(*) AS n, round(avg(e), 5) + 0.0::DOUBLE AS mean, round(stddev_pop(e), 5) AS std, round(min(e), 5) AS min, round(max(e), 5) AS max, round(median(e), 5) + 0.0::DOUBLE AS median,
 round(quantile_cont(e, 0.25), 5) + 0.0::DOUBLE AS q25, round(quantile_cont(e, 0.75), 5) + 0.0::DOUBLE AS q75 FROM e GROUP BY 1""")
def residual_stats(spark, sf):
    return rounded(metrics.residual_stats(b.monthly(spark, sf), "actual", "expected", ["asset_id"]), 5)


@query("residual_stats_all", sql="""
, e AS (SELECT l_quantity * 2000 - l_extendedprice AS e FROM lineitem)
SELECT count(*) AS n, round(avg(e), 4) + 0.0::DOUBLE AS mean, round(stddev_pop(e), 4) AS std, round(min(e), 4) AS min, round(max(e), 4) AS max, round(median(e), 4) + 0.0::DOUBLE AS median,
 round(quantile_cont(e, 0.25), 4) AS q25, round(quantile_cont(e, 0.75), 4) AS q75 FROM e""".replace(", e AS", "WITH e AS", 1))
def residual_stats_all(spark, sf):
    """One group that holds every row."""
    rows = b.table(spark, sf, "lineitem").select((F.col("l_quantity") * 2000).alias("y"), F.col("l_extendedprice").alias("p"))
    return rounded(metrics.residual_stats(rows, "y", "p"), 4)


@query("bias_stats", sql=with_(MONTHLY) + """
, e AS (SELECT asset_id, (expected - actual) / greatest(actual, 1e-9) * 100 AS p FROM monthly WHERE expected IS NOT NULL)
SELECT asset_id, count(*) AS n, round(avg(p), 5) + 0.0::DOUBLE AS mean_bias_pct, round(median(p), 5) + 0.0::DOUBLE AS median_bias_pct,
 round(count(*) FILTER (WHERE p > 0) / count(*)::DOUBLE * 100, 5) AS positive_bias_pct, round(count(*) FILTER (WHERE p < 0) / count(*)::DOUBLE * 100, 5) AS negative_bias_pct FROM e GROUP BY 1""")
def bias_stats(spark, sf):
    return rounded(metrics.bias_stats(b.monthly(spark, sf), "actual", "expected", ["asset_id"]), 5)


@query("forecast_accuracy", sql=ROLL.split("\n, roll AS")[0] + f"""
, cycle AS (SELECT asset_id, t % 6 + 1 AS step, actual, expected FROM monthly WHERE expected IS NOT NULL)
, h(horizon_days, m) AS (VALUES (30, 1), (90, 3), (180, 6))
, g AS (SELECT asset_id, horizon_days, {REG} FROM cycle JOIN h ON step <= m GROUP BY 1, 2)
SELECT asset_id, horizon_days, round(mae, 7) AS mae, round(rmse, 7) AS rmse, round(mape, 7) AS mape, n FROM g""")
def forecast_accuracy(spark, sf):
    """Every six months of the whole panel are one forecast of six steps."""
    cycle = b.monthly(spark, sf).withColumn("step", F.col("t") % 6 + 1)
    out = metrics.forecast_accuracy(cycle, "actual", "expected", "step", ["asset_id"])
    return rounded(out.select("asset_id", "horizon_days", "mae", "rmse", "mape", "n"), 7)


LONG = with_(MONTHLY) + f", g AS (SELECT asset_id, {REG} FROM monthly WHERE expected IS NOT NULL GROUP BY 1), long AS (" + " UNION ALL ".join(
    f"SELECT asset_id, '{c}' AS metric_name, {c} AS metric_value FROM g" for c in ("mae", "rmse", "r2", "mape")) + ")"


def long_metrics(spark, sf):
    wide = metrics.regression_metrics(b.monthly(spark, sf), "actual", "expected", ["asset_id"])
    return metrics.to_long(wide, ["asset_id"], ["mae", "rmse", "r2", "mape"])


@query("metrics_long", sql=LONG + " SELECT asset_id, metric_name, round(metric_value, 5) + 0.0::DOUBLE AS metric_value FROM long")
def metrics_long(spark, sf):
    return rounded(long_metrics(spark, sf), 5)


@query("metric_status", sql=LONG + """
SELECT asset_id, metric_name, CASE metric_name WHEN 'mae' THEN 80 ELSE 0.1::DOUBLE END::DOUBLE AS target,
 CASE WHEN (metric_name = 'mae' AND metric_value < 80) OR (metric_name = 'r2' AND metric_value > 0.1::DOUBLE) THEN 'PASS' ELSE 'FAIL' END AS status FROM long WHERE metric_name IN ('mae', 'r2')""")
def metric_status(spark, sf):
    out = metrics.metric_status(long_metrics(spark, sf), {"mae": ("<", 80.0), "r2": (">", 0.1)})
    return out.select("asset_id", "metric_name", "target", "status")
