"""Feature queries."""

from pyspark.sql import functions as F

from checks.base import ASSETS, EVENTS, MONTHLY, query, rounded, with_
from fieldspark.functions.columns import clean_text, deviation_pct, to_millions, to_thousands
from fieldspark.operators import features as ft
from fieldspark.plans import bindings as b

W = "WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)"
ROWF = """
, f AS (SELECT *, lag(production, 1) OVER w AS l1, lag(production, 3) OVER w AS l3, lag(production, 6) OVER w AS l6,
   avg(production) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rm,
   stddev_pop(production) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rs,
   avg(production) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bm,
   count(*) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c6,
   regr_slope(production, rn) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sl
 FROM (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS rn FROM {src} WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)) x
 WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp))
, sm AS (SELECT asset_id, month(timestamp) AS mo, avg(production) AS m FROM {src} GROUP BY 1, 2)
, so AS (SELECT asset_id, avg(production) AS o FROM {src} GROUP BY 1)
SELECT asset_id, {keep}, l1 AS production_lag_1, l3 AS production_lag_3, l6 AS production_lag_6,
  round(rm, 6) AS rolling_mean, round(rs, 6) + 0.0::DOUBLE AS rolling_std,
  round(coalesce(-(production - l1) / nullif(l1, 0), 0), 6) + 0.0::DOUBLE AS decline_rate,
  round(CASE WHEN c6 >= 3 THEN sl END, 6) + 0.0::DOUBLE AS trend_slope,
  round(CASE WHEN o > 0 THEN m / o ELSE 1 END, 6) AS seasonal_factor,
  round(coalesce((production - bm) / nullif(bm, 0), 0), 6) + 0.0::DOUBLE AS production_deviation
FROM f JOIN sm USING (asset_id) JOIN so USING (asset_id) WHERE mo = month(timestamp)"""


@query("features_all", sql=with_(EVENTS) + ROWF.format(src="events_telemetry", keep="event_id"))
def features_all(spark, sf):
    """Raw readings: each user is split over days, with the rows before a day carried in."""
    out = ft.build_features(b.events_telemetry(spark, sf))
    names = [c for c in out.columns if c.startswith(("production_", "rolling", "decline", "trend", "seasonal"))]
    return rounded(out.select("asset_id", "event_id", *names))


@query("features_monthly", sql=with_(MONTHLY, "p AS (SELECT asset_id, period AS timestamp, period, actual AS production FROM monthly)")
       + ROWF.format(src="p", keep="CAST(timestamp AS DATE) AS period"))
def features_monthly(spark, sf):
    panel = b.monthly(spark, sf).select("asset_id", "period", F.col("actual").alias("production"))
    out = ft.build_features(panel, time_col="period", slice_unit=None)
    names = [c for c in out.columns if c.startswith(("production_", "rolling", "decline", "trend", "seasonal"))]
    return rounded(out.select("asset_id", "period", *names))


@query("seasonal_index", sql=with_(MONTHLY) + """
, m AS (SELECT asset_id, t % 12 AS pos, avg(actual) AS m FROM monthly GROUP BY 1, 2)
, o AS (SELECT asset_id, avg(actual) AS o, count(*) AS n FROM monthly GROUP BY 1)
, r AS (SELECT asset_id, pos, m / o AS raw, n FROM m JOIN o USING (asset_id))
SELECT a.asset_id, CAST(a.pos AS INTEGER) AS pos, round(CASE WHEN a.n < 12 THEN 1 ELSE .25::DOUBLE * p.raw + .5::DOUBLE * a.raw + .25::DOUBLE * q.raw END, 6) AS index
FROM r a JOIN r p ON p.asset_id = a.asset_id AND p.pos = (a.pos + 11) % 12
JOIN r q ON q.asset_id = a.asset_id AND q.pos = (a.pos + 1) % 12""")
def seasonal_index(spark, sf):
    return rounded(ft.seasonal_index(b.monthly(spark, sf)))


@query("calendar_factors", sql=with_(MONTHLY) + """
, m AS (SELECT asset_id, month(period) AS mo, avg(actual) AS m FROM monthly GROUP BY 1, 2)
, o AS (SELECT asset_id, avg(actual) AS o FROM monthly GROUP BY 1)
SELECT o.asset_id, CAST(x.mo AS INTEGER) AS month, round(coalesce(m, 0) / o, 6) AS factor
FROM o CROSS JOIN (SELECT unnest(range(1, 13)) AS mo) x LEFT JOIN m ON m.asset_id = o.asset_id AND m.mo = x.mo""")
def calendar_factors(spark, sf):
    return rounded(ft.calendar_factors(b.monthly(spark, sf)))


AF = """
, av AS (SELECT * FROM monthly WHERE actual IS NOT NULL AND expected IS NOT NULL)
, af AS (SELECT *, (actual - expected) / greatest(expected, 1e-9) AS dev_fraction,
   avg(actual) OVER w3 AS rolling_mean, coalesce(stddev_samp(actual) OVER w3, 0) AS rolling_std,
   coalesce((actual - lag(actual) OVER w) / nullif(lag(actual) OVER w, 0), 0) AS change_rate
 FROM av WINDOW w AS (PARTITION BY asset_id ORDER BY period),
  w3 AS (PARTITION BY asset_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query("anomaly_features", sql=with_(MONTHLY) + AF + """
SELECT asset_id, period, actual, round(dev_fraction, 6) + 0.0::DOUBLE AS dev_fraction, round(rolling_mean, 6) AS rolling_mean,
  round(rolling_std, 6) + 0.0::DOUBLE AS rolling_std, round(change_rate, 6) + 0.0::DOUBLE AS change_rate FROM af""")
def anomaly_features(spark, sf):
    out = ft.anomaly_features(b.monthly(spark, sf))
    return rounded(out.select("asset_id", "period", "actual", "dev_fraction", "rolling_mean", "rolling_std", "change_rate"))


@query("anomaly_features_sliced", sql=with_(EVENTS, "monthly AS (SELECT asset_id, event_id, timestamp AS period, production AS actual, pressure AS expected FROM events_telemetry)")
       + AF + """
SELECT asset_id, event_id, round(dev_fraction, 6) + 0.0::DOUBLE AS dev_fraction, round(rolling_mean, 6) AS rolling_mean,
  round(rolling_std, 6) + 0.0::DOUBLE AS rolling_std, round(change_rate, 6) + 0.0::DOUBLE AS change_rate FROM af""")
def anomaly_features_sliced(spark, sf):
    rows = b.events_telemetry(spark, sf).select(
        "asset_id", "event_id", "timestamp", F.col("production").alias("actual"), F.col("pressure").alias("expected"))
    out = ft.anomaly_features(rows, order="timestamp", slice_unit="day")
    return rounded(out.select("asset_id", "event_id", "dev_fraction", "rolling_mean", "rolling_std", "change_rate"))


COVER = """, c AS (SELECT asset_id, event_id, pressure, CASE WHEN event_id % 3 = 0 THEN production END AS flow_rate,
  CASE WHEN event_id % 2 = 0 THEN production * 3 END AS temperature FROM events_telemetry)
, s AS (SELECT asset_id, count(*) AS n, """ + ", ".join(
    f"count({c}) AS n_{c}, avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("pressure", "flow_rate", "temperature")) + """
  FROM c GROUP BY 1)
SELECT asset_id, event_id, """ + ", ".join(
    f"n_{c} >= greatest(3, floor(n * 0.5)) AS has_{c}, round(CASE WHEN n_{c} >= greatest(3, floor(n * 0.5)) THEN "
    f"coalesce(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1e-9 ELSE s_{c} END, 0) END, 6) + 0.0::DOUBLE AS {c}_z"
    for c in ("pressure", "flow_rate", "temperature")) + " FROM c JOIN s USING (asset_id)"


@query("coverage_zscores", sql=with_(EVENTS) + COVER)
def coverage_zscores(spark, sf):
    cols = ("pressure", "flow_rate", "temperature")
    rows = b.events_telemetry(spark, sf).select(
        "asset_id", "event_id", "pressure", F.when(F.col("event_id") % 3 == 0, F.col("production")).alias("flow_rate"),
        F.when(F.col("event_id") % 2 == 0, F.col("production") * 3).alias("temperature"))
    out = ft.coverage_zscores(rows, cols)
    return rounded(out.select("asset_id", "event_id", *[f"has_{c}" for c in cols], *[f"{c}_z" for c in cols]))


RATE = "CASE WHEN {b} < 1e-4 THEN {qi} * exp(-{di} * {t}) ELSE {qi} * exp(-ln(1 + {b} * {di} * {t}) / {b}) END"
FF = """
, fx AS (SELECT p.*, first_value(actual) OVER (PARTITION BY asset_id ORDER BY t) AS f0,
   lag(actual, 1) OVER w AS a1, lag(actual, 2) OVER w AS a2, lag(actual, 3) OVER w AS a3, lag(actual, 6) OVER w AS a6,
   lag(actual, 12) OVER w AS a12,
   avg(actual) OVER (PARTITION BY asset_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3_mean,
   avg(actual) OVER (PARTITION BY asset_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS roll6_mean,
   stddev_pop(actual) OVER (PARTITION BY asset_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3_std,
   count(actual) OVER (PARTITION BY asset_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS c6,
   regr_slope(actual, t::DOUBLE) OVER (PARTITION BY asset_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sl
  FROM monthly p WINDOW w AS (PARTITION BY asset_id ORDER BY t))
, ff AS (SELECT asset_id, period, t, actual,
   CASE WHEN t > 0 THEN coalesce(a1, f0) END AS lag_1, CASE WHEN t > 0 THEN coalesce(a2, f0) END AS lag_2,
   CASE WHEN t > 0 THEN coalesce(a3, f0) END AS lag_3, CASE WHEN t > 0 THEN coalesce(a6, f0) END AS lag_6,
   CASE WHEN t > 0 THEN coalesce(a12, f0) END AS lag_12, roll3_mean, roll6_mean, roll3_std,
   CASE WHEN t > 0 THEN -(a1 - coalesce(a2, f0)) / greatest(abs(coalesce(a2, f0)), 1e-9) END AS decline_rate,
   CASE WHEN c6 >= 2 THEN sl ELSE 0 END AS trend_slope, sin((t % 12) * (2 * pi() / 12)) AS sin12,
   cos((t % 12) * (2 * pi() / 12)) AS cos12, """ + RATE.format(b="b", qi="qi", di="di", t="t") + """ AS decline_baseline,
   intervention_cost AS meta_intervention_cost, onstream_year::DOUBLE AS meta_onstream_year
  FROM fx JOIN assets USING (asset_id))"""
FCOLS = (*ft.FORECAST_FEATURES, "meta_intervention_cost", "meta_onstream_year")
FSEL = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in FCOLS)


def forecast_rows(spark, sf):
    panel = b.monthly(spark, sf).drop("expected").join(b.assets(spark, sf), "asset_id")
    return ft.forecast_features(panel, metadata=("onstream_year", "intervention_cost"))


@query("forecast_features", sql=with_(MONTHLY, ASSETS) + FF + f" SELECT asset_id, t, {FSEL} FROM ff")
def forecast_features(spark, sf):
    return rounded(forecast_rows(spark, sf).select("asset_id", "t", *FCOLS))


@query("supervised_matrix", sql=with_(MONTHLY, ASSETS) + FF + f"""
SELECT asset_id, t, actual, {FSEL} FROM ff WHERE t >= 13
QUALIFY count(*) OVER (PARTITION BY asset_id) >= 8""")
def supervised_matrix(spark, sf):
    matrix, _ = ft.supervised_matrix(forecast_rows(spark, sf))
    return rounded(matrix.select("asset_id", "t", "actual", *FCOLS))


@query("deviation_pct", sql=with_(MONTHLY) + """
SELECT asset_id, period, round(CASE WHEN expected IS NULL THEN NULL WHEN expected = 0 THEN 0
  ELSE (actual - expected) / expected * 100 END, 6) + 0.0::DOUBLE AS deviation_pct,
  round(actual / 1000, 6) AS thousands, round(actual / 1000000, 9) AS millions FROM monthly""")
def deviation(spark, sf):
    out = b.monthly(spark, sf)
    return out.select("asset_id", "period",
                      (F.round(deviation_pct(F.col("actual"), F.col("expected")), 6) + F.lit(0.0)).alias("deviation_pct"),
                      F.round(to_thousands(F.col("actual")), 6).alias("thousands"),
                      F.round(to_millions(F.col("actual")), 9).alias("millions"))


@query("volatility", sql=with_(MONTHLY) + """
, p AS (SELECT asset_id, t, actual, (actual - lag(actual) OVER w) / nullif(lag(actual) OVER w, 0) AS pct,
   max(t) OVER (PARTITION BY asset_id) AS last_t FROM monthly WINDOW w AS (PARTITION BY asset_id ORDER BY t))
SELECT asset_id, round(stddev_samp(pct), 6) AS volatility,
  round(regr_slope(actual, t::DOUBLE) FILTER (WHERE t > last_t - 12), 6) + 0.0::DOUBLE AS trend12 FROM p GROUP BY 1""")
def volatility(spark, sf):
    return rounded(ft.volatility(b.monthly(spark, sf)))


@query("clean_text", sql="""SELECT c_custkey, trim(substr(concat('  ', c_name, ' ', c_mktsegment), 1, 20)) AS label FROM customer""")
def text_label(spark, sf):
    text = F.concat(F.lit("  "), "c_name", F.lit(" "), "c_mktsegment")
    return b.table(spark, sf, "customer").select("c_custkey", clean_text(text, 20).alias("label"))
