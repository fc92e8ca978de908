"""Decline-curve queries. The oracle searches the same grid with plain joins and grouped sums."""

import math

from pyspark.sql import functions as F

from checks.base import ASSETS, MONTHLY, query, rounded, with_
from checks.features import RATE
from fieldspark.functions import curve_search as cs
from fieldspark.functions.columns import catalogue_rate, hyperbolic_rate
from fieldspark.operators import decline as dc
from fieldspark.plans import bindings as b

FACTORS = (0.96, 0.97, 0.99, 1.01, 1.02, 1.03, 1.03, 1.02, 1.01, 1.0, 0.98, 0.98)
UNIT = RATE.format(b="g.b", qi="1.0::DOUBLE", di="g.di", t="s.t")


def fit_ctes(source: str = "monthly", zooms: int = 2) -> str:
    """CTEs fit0..fitN; fit<zooms> has asset_id, di, b, qi, sse."""
    coarse = ", ".join(f"({i}, {di!r}::DOUBLE, {bb!r}::DOUBLE)" for i, (di, bb) in enumerate(cs.coarse_cells()))
    parts = [f"""
, ser AS (SELECT asset_id, t, actual AS y FROM {source})
, bnd AS (SELECT asset_id, min(y) * 0.1::DOUBLE AS lo, max(y) * 10 AS hi, sum(y * y) AS yy FROM ser GROUP BY 1)
, grid0(cell, di, b) AS (VALUES {coarse})
, cells0 AS (SELECT s.asset_id, g.cell, g.di, g.b, sum(s.y * ({UNIT})) AS yf, sum(({UNIT}) * ({UNIT})) AS ff
   FROM ser s CROSS JOIN grid0 g GROUP BY 1, 2, 3, 4)"""]
    for r in range(zooms + 1):
        if r:
            ls, bs = cs.zoom_steps(r)
            offs = [(i, j) for i in range(-cs.ZOOM, cs.ZOOM + 1) for j in range(-cs.ZOOM, cs.ZOOM + 1)]
            vals = ", ".join(f"({n}, {math.exp(ls * i)!r}::DOUBLE, {bs * j!r}::DOUBLE)" for n, (i, j) in enumerate(offs))
            parts.append(f"""
, off{r}(cell, r, d) AS (VALUES {vals})
, grid{r} AS (SELECT asset_id, cell, least(greatest(di * r, 1e-4::DOUBLE), 0.9::DOUBLE) AS di,
   least(greatest(b + d, 0.0::DOUBLE), 1.0::DOUBLE) AS b FROM fit{r - 1} CROSS JOIN off{r})
, cells{r} AS (SELECT s.asset_id, g.cell, g.di, g.b, sum(s.y * ({UNIT})) AS yf, sum(({UNIT}) * ({UNIT})) AS ff
   FROM ser s JOIN grid{r} g ON s.asset_id = g.asset_id GROUP BY 1, 2, 3, 4)""")
        parts.append(f"""
, fit{r} AS MATERIALIZED (SELECT asset_id, di, b, qi, sse FROM (
   SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY sse, di, b) AS rn FROM (
    SELECT *, yy - 2 * qi * yf + qi * qi * ff AS sse FROM (
     SELECT c.*, bnd.yy, least(greatest(yf / ff, lo), hi) AS qi FROM cells{r} c JOIN bnd USING (asset_id)) x) y) z WHERE rn = 1)""")
    return "".join(parts)


FITTED = RATE.format(b="f.b", qi="f.qi", di="f.di", t="s.t")


@query("decline_fit", sql=with_(MONTHLY) + fit_ctes() + """
SELECT asset_id, round(qi, 4) AS qi, round(di, 8) AS di, round(b, 6) AS b FROM fit2""")
def decline_fit(spark, sf):
    out = dc.fit_decline(b.monthly(spark, sf))
    return out.select("asset_id", F.round("qi", 4).alias("qi"), F.round("di", 8).alias("di"), F.round("b", 6).alias("b"))


@query("decline_quality", sql=with_(MONTHLY) + fit_ctes() + f"""
, r AS (SELECT s.asset_id, s.y, s.y - ({FITTED}) AS e FROM ser s JOIN fit2 f USING (asset_id))
, q AS (SELECT asset_id, count(*) AS n, avg(abs(e)) AS mae, avg(e) AS residual_mean, stddev_pop(e) AS residual_std,
   max(abs(e)) AS residual_max_abs, avg(e) / greatest(avg(y), 1e-9) * 100 AS bias_pct,
   least(greatest(1 - sum(e * e) / (var_pop(y) * count(*)), 0), 1) AS r_squared FROM r GROUP BY 1)
SELECT asset_id, CAST(n AS INTEGER) AS n, round(mae, 5) AS mae, round(residual_mean, 5) + 0.0::DOUBLE AS residual_mean,
  round(residual_std, 5) AS residual_std, round(residual_max_abs, 5) AS residual_max_abs,
  round(bias_pct, 5) + 0.0::DOUBLE AS bias_pct, round(r_squared, 5) AS r_squared,
  round(0.99::DOUBLE * r_squared, 5) AS confidence, r_squared < 0.8 AS low_fit FROM q""")
def decline_quality(spark, sf):
    out = dc.fit_quality(dc.fit_decline(b.monthly(spark, sf)))
    return rounded(out.select("asset_id", "n", "mae", "residual_mean", "residual_std", "residual_max_abs", "bias_pct",
                              "r_squared", "confidence", "low_fit"), 5)


HR = ", ".join(
    f"round({RATE.format(b='b', qi='qi', di='di', t=f'(last_t + {d} / 30.4375::DOUBLE)')}, 6) AS rate_{d}d" for d in (30, 90, 180, 365))


@query("horizon_rates", sql=with_(MONTHLY, ASSETS) + f"""
, l AS (SELECT asset_id, max(t) AS last_t FROM monthly GROUP BY 1)
SELECT asset_id, {HR}, round(least(greatest(round(di / (1 + b * di * last_t) * 100, 4), 0), 19.999), 6) AS current_decline_pct
FROM l JOIN assets USING (asset_id)""")
def horizon_rates(spark, sf):
    last = b.monthly(spark, sf).groupBy("asset_id").agg(F.max("t").cast("double").alias("last_t"))
    out = dc.horizon_rates(last.join(b.assets(spark, sf), "asset_id"), F.col("last_t"))
    return rounded(out.select("asset_id", *[f"rate_{d}d" for d in (30, 90, 180, 365)], "current_decline_pct"))


@query("decline_report", sql=with_(MONTHLY, ASSETS) + """
, l AS (SELECT asset_id, max(t) AS lt FROM monthly GROUP BY 1)
, r AS (SELECT asset_id, di / (1 + b * di * lt) AS nom, (1 - power((1 + b * di * lt) / (1 + b * di * (lt + 12)), 1 / b)) * 100 AS eff
  FROM l JOIN assets USING (asset_id))
SELECT asset_id, round(nom, 6) AS nominal_decline_per_month, round(nom * 100, 4) AS decline_pct_per_month,
  round(least(greatest(eff, 1e-6), 99.999), 3) AS effective_decline_pct_per_year FROM r""")
def decline_report(spark, sf):
    last = b.monthly(spark, sf).groupBy("asset_id").agg(F.max("t").cast("double").alias("lt"))
    out = dc.decline_report(last.join(b.assets(spark, sf), "asset_id"), F.col("lt"))
    return out.select("asset_id", "nominal_decline_per_month", "decline_pct_per_month", "effective_decline_pct_per_year")


GRID_RATE = ("CASE WHEN {b} < 1e-3 THEN {qi} * exp(-{di} * {t}) WHEN 1 + {b} * {di} * {t} <= 0 THEN NULL "
             "ELSE {qi} * exp(-ln(1 + {b} * {di} * {t}) / {b}) END")
GR = GRID_RATE.format(b="g.b", qi="g.qi", di="g.di", t="(s.t + 1)")


def _grid_round(name: str, source: str) -> str:
    return f"""
, {name}c AS (SELECT g.asset_id, g.n, g.qi, g.di, g.b, CASE WHEN count(*) FILTER (WHERE ({GR}) IS NULL) > 0 THEN 'inf'::DOUBLE
    ELSE sum((s.y - ({GR})) * (s.y - ({GR}))) END AS sse FROM ser s JOIN {source} g ON s.asset_id = g.asset_id GROUP BY 1, 2, 3, 4, 5)
, {name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY sse, n) AS rn FROM {name}c) x WHERE rn = 1)"""


GRID_CTES = """
, ser AS (SELECT asset_id, t, actual AS y FROM monthly)
, q0 AS (SELECT asset_id, y AS q0 FROM ser WHERE t = 0)
, idx AS (SELECT (i * 25 + j * 5 + k)::INTEGER AS n, i::DOUBLE AS i, j::DOUBLE AS j, k::DOUBLE AS k FROM (SELECT unnest(range(5)) AS i) a,
   (SELECT unnest(range(5)) AS j) b, (SELECT unnest(range(5)) AS k) c)
, g0 AS (SELECT asset_id, n, q0 * 0.8::DOUBLE + i * (q0 * 0.1::DOUBLE) AS qi, 0.01::DOUBLE + j * 0.0275::DOUBLE AS di,
   0.1::DOUBLE + k * 0.225::DOUBLE AS b FROM q0 CROSS JOIN idx)""" + _grid_round("co", "g0") + """
, g1 AS (SELECT co.asset_id, idx.n, co.qi - q0 * 0.1::DOUBLE + i * (q0 * 0.05::DOUBLE) AS qi, co.di - 0.0275::DOUBLE + j * 0.01375::DOUBLE AS di,
   co.b - 0.225::DOUBLE + k * 0.1125::DOUBLE AS b FROM co JOIN q0 USING (asset_id) CROSS JOIN idx)""" + _grid_round("fi", "g1") + """
, gw AS (SELECT asset_id, CASE WHEN fi.sse < co.sse THEN fi.qi ELSE co.qi END AS qi, CASE WHEN fi.sse < co.sse THEN fi.di ELSE co.di END AS di,
   CASE WHEN fi.sse < co.sse THEN fi.b ELSE co.b END AS b, least(fi.sse, co.sse) AS sse FROM fi JOIN co USING (asset_id))"""


@query("decline_fit_grid", sql=with_(MONTHLY) + GRID_CTES + f"""
SELECT asset_id, round(g.qi, 5) AS qi, round(g.di, 7) + 0.0::DOUBLE AS di, round(g.b, 6) + 0.0::DOUBLE AS b,
  round(avg(abs(s.y - ({GR}))), 5) AS mae, round(1 - g.sse / (var_pop(s.y) * count(*)), 5) AS r_squared,
  round(sqrt(g.sse / (count(*) - 3)), 5) AS std_error,
  round({GRID_RATE.format(b='g.b', qi='g.qi', di='g.di', t='3')}, 5) AS rate_90d
FROM gw g JOIN ser s USING (asset_id) GROUP BY asset_id, g.qi, g.di, g.b, g.sse""")
def decline_fit_grid(spark, sf):
    out = dc.fit_decline_grid(b.monthly(spark, sf))
    return out.select("asset_id", F.round("qi", 5).alias("qi"), (F.round("di", 7) + F.lit(0.0)).alias("di"),
                      (F.round("b", 6) + F.lit(0.0)).alias("b"), F.round("mae", 5).alias("mae"),
                      F.round("r_squared", 5).alias("r_squared"), F.round("std_error", 5).alias("std_error"),
                      F.round("rate_90d", 5).alias("rate_90d"))


@query("fitted_curve", sql=with_(MONTHLY) + fit_ctes() + f"""
SELECT s.asset_id, s.t AS month, s.y AS observed, round({FITTED}, 4) AS fitted FROM ser s JOIN fit2 f USING (asset_id)""")
def fitted_curve(spark, sf):
    return rounded(dc.fitted_curve(dc.fit_decline(b.monthly(spark, sf))), 4)


CAT = ("CASE WHEN m <= 0 THEN qi WHEN b < 1e-3 THEN qi * exp(-di * m) ELSE qi * exp(-ln(1 + b * di * m) / b) END")


@query("forecast_decline", sql=with_(ASSETS) + f"""
SELECT asset_id, CAST(m AS INTEGER) AS month, round({CAT}, 6) AS rate FROM assets CROSS JOIN (SELECT unnest(range(1, 25)) AS m) x""")
def forecast_decline(spark, sf):
    return rounded(dc.forecast_decline(b.assets(spark, sf), 24))


@query("decline_rate_at", sql=with_(MONTHLY, ASSETS) + f"""
, p AS (SELECT asset_id, period, (t - 3)::DOUBLE AS m, t, qi, di, b FROM monthly JOIN assets USING (asset_id))
SELECT asset_id, period, round({RATE.format(b='b', qi='qi', di='di', t='t')}, 6) AS rate, round({CAT}, 6) AS catalogue FROM p""")
def decline_rate_at(spark, sf):
    p = b.monthly(spark, sf).drop("expected").join(b.assets(spark, sf), "asset_id")
    args = (F.col("qi"), F.col("di"), F.col("b"))
    return rounded(p.select("asset_id", "period", hyperbolic_rate(*args, F.col("t").cast("double")).alias("rate"),
                            catalogue_rate(*args, (F.col("t") - 3).cast("double")).alias("catalogue")))


FACTOR_SQL = "[" + ", ".join(f"{v}::DOUBLE" for v in FACTORS) + "][month(period)]"


@query("expected_series", sql=with_(MONTHLY, ASSETS, "dormant AS (SELECT m.* FROM monthly m JOIN assets USING (asset_id) WHERE status <> 'ACTIVE')")
       + fit_ctes("dormant") + f"""
SELECT m.asset_id, m.period, round(CASE WHEN a.status = 'ACTIVE' THEN ({RATE.format(b='a.b', qi='a.qi', di='a.di', t='m.t')}) * {FACTOR_SQL}
  ELSE ({RATE.format(b='f.b', qi='f.qi', di='f.di', t='m.t')}) END, 4) AS expected
FROM monthly m JOIN assets a USING (asset_id) LEFT JOIN fit2 f USING (asset_id)""")
def expected_series(spark, sf):
    active = b.assets(spark, sf).where(F.col("status") == "ACTIVE")
    out = dc.expected_series(b.monthly(spark, sf).drop("expected"), active, FACTORS)
    return rounded(out.select("asset_id", "period", "expected"), 4)
