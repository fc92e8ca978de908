"""Fact rows that the analysis stores, the load summary, and the whole analysis."""

from pyspark.sql import functions as F

from checks.base import TELEMETRY_RAW, query, rounded, with_
from checks.decline import FACTORS
from checks.scoring import ALL, SEV, ruled, scored
from fieldspark.operators import anomaly, quality
from fieldspark.plans import bindings as b
from fieldspark.plans.analysis import analyze
from fieldspark.sources import readers, sinks


@query("anomaly_fact_rows", sql=ALL + f"""
SELECT asset_id, flagged_period AS event_date, round(anomaly_score, 6) AS anomaly_score, {SEV.format(s='anomaly_score')} AS severity,
  round(flagged_dev_fraction * 100, 6) AS production_deviation, 'UNACKNOWLEDGED' AS status FROM state WHERE flagged_period IS NOT NULL""")
def anomaly_fact_rows(spark, sf):
    return rounded(sinks.anomaly_rows(anomaly.latest_window(anomaly.detect_windows(ruled(spark, sf)))))


@query("score_fact_rows", sql=ALL + """
SELECT asset_id, round(score, 5) AS score, priority, round(loss_pct, 5) AS loss_magnitude, round(anomaly_score * 100, 5) AS anomaly_severity,
  round(recovery_pct, 5) AS recovery_opportunity, round(combined_confidence, 5) AS recovery_confidence, round(complexity * 100, 5) AS intervention_complexity FROM prio""")
def score_fact_rows(spark, sf):
    return rounded(sinks.score_rows(scored(spark, sf)), 5)


@query("metric_fact_rows", sql=ALL + """
SELECT asset_id, 'loss_pct' AS metric_name, round(loss_pct, 5) AS metric_value FROM prio UNION ALL SELECT asset_id, 'score', round(score, 5) FROM prio""")
def metric_fact_rows(spark, sf):
    return rounded(sinks.metric_rows(scored(spark, sf), ["asset_id"], ["loss_pct", "score"]), 5)


@query("load_summary", sql=with_(TELEMETRY_RAW) + """
SELECT count(*) AS rows, CAST(min(timestamp) AS DATE) AS first_day, CAST(max(timestamp) AS DATE) AS last_day, 'DERIVED,REAL,SYNTHETIC' AS source_types,
  'l_orderkey,l_linenumber' AS unmapped FROM telemetry_raw""")
def load_summary(spark, sf):
    raw = b.telemetry_raw(spark, sf).drop("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = readers.load_summary(readers.from_df(raw, strict=False), raw.columns)
    return out.select("rows", F.to_date("first_ts").alias("first_day"), F.to_date("last_ts").alias("last_day"), "source_types", "unmapped")


@query("analyze_all")
def analyze_all(spark, sf):
    """Every asset through decline fit, forest, forecast, backtest, score and rank."""
    labels = quality.provenance_label(b.telemetry_raw(spark, sf))
    out = analyze(b.monthly(spark, sf), b.assets(spark, sf), FACTORS, provenance=labels)
    return out.select(
        "rank", "asset_id", "basin", "severity", "priority", F.round("score", 4).alias("score"), F.round("anomaly_score", 4).alias("anomaly_score"),
        F.round("r_squared", 4).alias("r_squared"), F.round("forecast_90d", 4).alias("forecast_90d"), F.round("backtest.mae", 4).alias("backtest_mae"),
        F.round("detector_metrics.f1", 4).alias("detector_f1"), F.size("windows").alias("recent_windows"), "lead_action", "provenance")
