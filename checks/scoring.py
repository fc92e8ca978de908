"""Scoring, ranking and portfolio queries. The anomaly score here is that of the deviation rule."""

from pyspark.sql import functions as F

from checks.base import ASSETS, EVENTS, LINE_ORDER, MONTHLY, TELEMETRY_RAW, query, rounded, with_
from checks.features import AF
from fieldspark.functions.columns import is_anomalous, rule_score, severity
from fieldspark.operators import anomaly, features, pages, portfolio, scoring
from fieldspark.plans import bindings as b
from fieldspark.session import scratch_path

RULED = AF + """
, ruled AS (SELECT *, CASE WHEN abs(dev_fraction) >= 0.1::DOUBLE THEN least(abs(dev_fraction) / 0.2::DOUBLE, 1) ELSE 0 END::DOUBLE AS anomaly_score FROM af)"""
SEV = "CASE WHEN {s} >= 0.85::DOUBLE THEN 'CRITICAL' WHEN {s} >= 0.7::DOUBLE THEN 'ALERT' WHEN {s} >= 0.5::DOUBLE THEN 'WATCH' ELSE 'NORMAL' END"
STATE = RULED + f"""
, lastrow AS (SELECT * FROM ruled QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY period DESC) = 1)
, flagged AS (SELECT asset_id, period AS flagged_period, anomaly_score, dev_fraction AS flagged_dev_fraction, change_rate AS flagged_change_rate
   FROM ruled WHERE anomaly_score >= 0.5 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY period DESC) = 1)
, nwin AS (SELECT asset_id, CAST(count(*) FILTER (WHERE anomaly_score >= 0.5) AS INTEGER) AS n_windows FROM ruled GROUP BY 1)
, state AS (SELECT l.asset_id, l.period, l.t, l.actual, l.expected, l.dev_fraction, l.change_rate, l.anomaly_score AS current_score,
   coalesce(f.anomaly_score, 0) AS anomaly_score, f.flagged_period, f.flagged_dev_fraction, f.flagged_change_rate, n_windows,
   CASE WHEN expected = 0 THEN 0 ELSE (actual - expected) / expected * 100 END AS deviation_pct
  FROM lastrow l LEFT JOIN flagged f USING (asset_id) JOIN nwin USING (asset_id))
, rec AS (SELECT *, {SEV.format(s='anomaly_score')} AS severity, greatest(expected - actual, 0) AS gap,
   CASE WHEN anomaly_score > 0.85::DOUBLE THEN 0.9::DOUBLE WHEN anomaly_score >= 0.7::DOUBLE THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS model_confidence,
   least(greatest(0.3::DOUBLE + coalesce(intervention_cost, 1) / 4, 0), 1) AS complexity
  FROM state LEFT JOIN assets USING (asset_id))
, rec2 AS (SELECT *, gap * 365 / 1e6 AS loss_volume, (0.8::DOUBLE + model_confidence) / 2 AS combined_confidence,
   gap * 365 / 1e6 * 0.8::DOUBLE * model_confidence AS recovery_volume,
   gap * 365 / 1e6 * 0.8::DOUBLE * model_confidence * 75 AS recovery_value,
   abs(expected - actual) / greatest(expected, 1e-9) * 100 AS loss_pct,
   greatest(expected - actual, 0) / greatest(expected, 1e-9) * 100 * 0.8::DOUBLE * model_confidence AS recovery_pct FROM rec)
, sc AS (SELECT *, 0.3::DOUBLE * loss_pct AS loss_part, 0.25::DOUBLE * anomaly_score * 100 AS anomaly_part,
   0.35::DOUBLE * recovery_pct AS recovery_part, -0.1::DOUBLE * complexity * 100 AS complexity_part FROM rec2)
, sc2 AS (SELECT *, loss_part + anomaly_part + recovery_part + complexity_part AS raw_score FROM sc)
, scored AS (SELECT *, least(greatest(raw_score / 30 * 100, 0), 100) AS score FROM sc2)
, prio AS (SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM scored)
, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, asset_id) AS rank FROM prio)"""
ALL = with_(MONTHLY, ASSETS) + STATE


def ruled(spark, sf):
    feats = features.anomaly_features(b.monthly(spark, sf))
    return feats.withColumn("anomaly_score", rule_score(F.col("dev_fraction")))


def scored(spark, sf):
    return portfolio.score_assets(portfolio.latest_state(ruled(spark, sf)), b.assets(spark, sf))


@query("flagship_priority_ranking", sql=ALL + """
SELECT rank, asset_id, basin, field_name, severity, priority, round(score, 4) AS score, round(anomaly_score, 4) AS anomaly_score,
  round(actual, 4) AS actual, round(expected, 4) AS expected, round(deviation_pct, 4) AS deviation_pct,
  round(recovery_volume, 8) AS recovery_volume FROM ranked""")
def flagship(spark, sf):
    out = portfolio.rank_assets(scored(spark, sf))
    return rounded(out.select("rank", "asset_id", "basin", "field_name", "severity", "priority", "score", "anomaly_score",
                              "actual", "expected", "deviation_pct"), 4).join(
        out.select("asset_id", F.round("recovery_volume", 8).alias("recovery_volume")), "asset_id")


@query("severity_bands", sql=with_(MONTHLY) + RULED + f"""
SELECT asset_id, period, {SEV.format(s='anomaly_score')} AS severity, anomaly_score >= 0.7 AS anomalous FROM ruled""")
def severity_bands(spark, sf):
    return ruled(spark, sf).select("asset_id", "period", severity(F.col("anomaly_score")).alias("severity"),
                                   is_anomalous(F.col("anomaly_score"), 0.7).alias("anomalous"))


@query("latest_state", sql=ALL + f"""
SELECT asset_id, period, t, n_windows, flagged_period, {SEV.format(s='anomaly_score')} AS severity, round(current_score, 6) AS current_score,
  round(anomaly_score, 6) AS anomaly_score, round(deviation_pct, 6) + 0.0::DOUBLE AS deviation_pct FROM state""")
def latest_state(spark, sf):
    out = portfolio.latest_state(ruled(spark, sf))
    return rounded(out.select("asset_id", "period", "t", "n_windows", "flagged_period", "severity", "current_score",
                              "anomaly_score", "deviation_pct"))


@query("recovery", sql=ALL + """
SELECT asset_id, round(gap, 6) AS gap, round(loss_volume, 8) AS loss_volume, model_confidence, round(combined_confidence, 6) AS combined_confidence,
  round(recovery_volume, 8) AS recovery_volume, round(recovery_value, 6) AS recovery_value FROM rec2""")
def recovery(spark, sf):
    out = scoring.recovery(portfolio.latest_state(ruled(spark, sf)))
    return out.select("asset_id", F.round("gap", 6).alias("gap"), F.round("loss_volume", 8).alias("loss_volume"), "model_confidence",
                      F.round("combined_confidence", 6).alias("combined_confidence"), F.round("recovery_volume", 8).alias("recovery_volume"),
                      F.round("recovery_value", 6).alias("recovery_value"))


PARTS = ("loss_part", "anomaly_part", "recovery_part", "complexity_part", "raw_score", "score")


@query("priority_score", sql=ALL + " SELECT asset_id, priority, concat_ws(',', CASE WHEN anomaly_score < 0.5 AND loss_pct > 20 THEN "
       "'LOSS_WITHOUT_ANOMALY' END, CASE WHEN gap <= 0 THEN 'NO_GAP' END) AS warnings, "
       + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in PARTS) + " FROM prio")
def priority_score(spark, sf):
    out = scored(spark, sf)
    return rounded(out.select("asset_id", "priority", F.array_join("warnings", ",").alias("warnings"), *PARTS))


@query("financials", sql=ALL + """
SELECT asset_id, round(recovery_value, 6) AS recovery_value, round(intervention_cost, 6) AS intervention_cost,
  round(recovery_value / greatest(intervention_cost, 1e-9), 1) AS roi_multiple FROM prio""")
def financials(spark, sf):
    return rounded(scored(spark, sf).select("asset_id", "recovery_value", "intervention_cost", "roi_multiple"))


@query("recommendations", sql=ALL + """
, r AS (SELECT *, abs(deviation_pct) < 5 AND anomaly_score < 0.5 AS calm, recovery_pct >= 8 OR recovery_volume >= 0.05 AS meaningful FROM prio)
, c AS (SELECT asset_id, priority, [CASE WHEN complexity > 0.7::DOUBLE AND meaningful THEN 'COMPLEXITY_FEASIBILITY_REVIEW' END,
   CASE WHEN meaningful AND combined_confidence < 0.6 THEN 'CONFIDENCE_GAP_REVIEW' END,
   CASE WHEN meaningful AND combined_confidence >= 0.6 THEN 'FIELD_VERIFICATION_RECOMMENDED' END,
   CASE WHEN NOT calm AND (abs(deviation_pct) >= 5 OR anomaly_score >= 0.7) THEN 'INVESTIGATE_DEVIATION' END,
   CASE WHEN calm THEN 'MONITOR_ASSET' END, CASE WHEN priority IN ('HIGH', 'CRITICAL') THEN 'PRIORITIZE_ENGINEERING_REVIEW' END,
   CASE WHEN NOT calm AND (anomaly_score >= 0.7 OR severity IN ('ALERT', 'CRITICAL')) THEN 'VERIFY_OPERATIONAL_PARAMETERS' END] AS codes FROM r)
SELECT asset_id, priority, coalesce(nullif(array_to_string(list_filter(codes, lambda x: x IS NOT NULL), ','), ''), 'NO_ACTION_INDICATED') AS codes FROM c""")
def recommendations(spark, sf):
    out = scored(spark, sf)
    return out.select("asset_id", "priority", F.array_join(F.transform("recommendations", lambda r: r["code"]), ",").alias("codes"))


@query("what_if", sql=ALL + """
SELECT asset_id, pct::DOUBLE AS pct, round(gap * pct / 100, 6) AS closed_gap, round(actual + gap * pct / 100, 6) AS scenario_level,
  round(loss_volume * pct / 100, 12) AS scenario_volume, round(recovery_value * pct / 100, 10) AS scenario_value
FROM prio CROSS JOIN (SELECT unnest([10, 20, 30, 45]) AS pct) p""")
def what_if(spark, sf):
    out = scoring.what_if(scored(spark, sf), (10, 20, 30, 45))
    return out.select("asset_id", "pct", F.round("closed_gap", 6).alias("closed_gap"), F.round("scenario_level", 6).alias("scenario_level"),
                      F.round("scenario_volume", 12).alias("scenario_volume"), F.round("scenario_value", 10).alias("scenario_value"))


@query("verification_list", sql=ALL + """
, v AS (SELECT asset_id, n_windows, [CASE WHEN abs(deviation_pct) > 5 THEN 'meter' END, CASE WHEN top = 'lag_1' THEN 'pressure' END,
   CASE WHEN top = 'roll3_mean' THEN 'flow' END, CASE WHEN top = 'meta_cost' THEN 'temperature' END,
   CASE WHEN top = 'decline_rate' THEN 'decline' END, CASE WHEN anomaly_score >= 0.7 THEN 'alarms' END] AS e
  FROM (SELECT *, CASE t % 4 + length(asset_id) % 2 WHEN 0 THEN 'lag_1' WHEN 1 THEN 'roll3_mean' WHEN 2 THEN 'meta_cost' WHEN 3 THEN 'decline_rate' ELSE 'sin12' END AS top FROM prio) x)
, v2 AS (SELECT asset_id, n_windows, list_filter(e, lambda x: x IS NOT NULL) AS e FROM v)
SELECT asset_id, array_to_string(list_slice(list_filter(list_concat(e, [CASE WHEN len(e) < 3 THEN 'history' END, CASE WHEN n_windows >= 2 THEN 'design' END]),
  lambda x: x IS NOT NULL), 1, 4), ',') AS checks FROM v2""")
def verification_list(spark, sf):
    n = F.col("t") % 4 + F.length("asset_id") % 2
    top = F.when(n == 0, "lag_1").when(n == 1, "roll3_mean").when(n == 2, "meta_cost").when(n == 3, "decline_rate").otherwise("sin12")
    out = scoring.verification_codes(scored(spark, sf).withColumn("top_feature", top))
    return out.select("asset_id", F.array_join("checks", ",").alias("checks"))


@query("sanitize_text", sql="""
SELECT o_orderkey, CASE WHEN regexp_matches(txt, 'valve\\s+fail|pump\\s+fail|reservoir\\s+damage|confirmed|catastrophic|irreversible', 'i')
  THEN 'Verify in the field before naming a cause' ELSE txt END AS action
FROM (SELECT o_orderkey, concat(CASE o_orderkey % 6 WHEN 0 THEN 'VALVE  failure at ' WHEN 1 THEN 'Confirmed loss: ' WHEN 2 THEN 'pump check: ' ELSE 'Inspect ' END, o_orderpriority) AS txt FROM orders) x""")
def sanitize_text(spark, sf):
    k = F.col("o_orderkey") % 6
    start = F.when(k == 0, "VALVE  failure at ").when(k == 1, "Confirmed loss: ").when(k == 2, "pump check: ").otherwise("Inspect ")
    return b.table(spark, sf, "orders").select(
        "o_orderkey", scoring.sanitize_text(F.concat(start, F.col("o_orderpriority"))).alias("action"))


BOARD = """
, board AS (SELECT rank, asset_id, field_name, basin, status, round(actual / 1000, 3) AS current_k, round(expected / 1000, 3) AS expected_k,
  round(deviation_pct, 2) + 0.0::DOUBLE AS deviation_pct, severity, round(anomaly_score, 3) AS anomaly_score, round(score, 1) AS score, priority,
  round(recovery_volume, 6) AS recovery_volume FROM ranked)"""


def board(spark, sf):
    out = portfolio.leaderboard(portfolio.rank_assets(scored(spark, sf)))
    return out.withColumn("deviation_pct", F.col("deviation_pct") + F.lit(0.0))


@query("rank_assets", sql=ALL + " SELECT rank, asset_id, round(score, 6) AS score FROM ranked")
def rank_assets(spark, sf):
    return rounded(portfolio.rank_assets(scored(spark, sf)).select("rank", "asset_id", "score"))


@query("leaderboard", sql=ALL + BOARD + " SELECT * FROM board")
def leaderboard(spark, sf):
    return board(spark, sf)


@query("leaderboard_filtered", sql=ALL + BOARD + """
SELECT rank, asset_id, basin, priority FROM board WHERE (contains(lower(asset_id), 'a') OR contains(lower(field_name), 'a') OR contains(lower(basin), 'a'))
 AND severity IN ('WATCH', 'ALERT', 'CRITICAL') AND priority IN ('HIGH', 'CRITICAL', 'MEDIUM') AND abs(deviation_pct) >= 5 AND recovery_volume >= 0""")
def leaderboard_filtered(spark, sf):
    out = portfolio.filter_leaderboard(board(spark, sf), "A", ("HIGH", "CRITICAL", "MEDIUM"), (), ("WATCH", "ALERT", "CRITICAL"), 5.0, 0.0)
    return out.select("rank", "asset_id", "basin", "priority")


@query("leaderboard_page", sql=ALL + BOARD + " SELECT rank, asset_id, score FROM board ORDER BY basin, rank LIMIT 10 OFFSET 20")
def leaderboard_page(spark, sf):
    return portfolio.page(board(spark, sf), [F.col("basin"), F.col("rank")], 3).select("rank", "asset_id", "score")


@query("leaderboard_page_count", sql=ALL + " SELECT count(*) AS rows, CAST(greatest(ceil(count(*) / 10), 1) AS BIGINT) AS pages FROM ranked")
def leaderboard_page_count(spark, sf):
    return portfolio.page_count(scored(spark, sf))


@query("portfolio_summary", sql=ALL + """
SELECT count(*) AS total_assets, count(*) FILTER (WHERE status = 'ACTIVE') AS active_assets,
  count(*) FILTER (WHERE status = 'ACTIVE' AND anomaly_score >= 0.5) AS at_risk_assets,
  round(sum(actual) FILTER (WHERE status = 'ACTIVE') / 1000, 2) AS current_k, round(sum(expected) FILTER (WHERE status = 'ACTIVE') / 1000, 2) AS expected_k,
  round((sum(actual) FILTER (WHERE status = 'ACTIVE') - sum(expected) FILTER (WHERE status = 'ACTIVE')) / sum(expected) FILTER (WHERE status = 'ACTIVE') * 100, 2) AS deviation_pct
FROM prio""")
def portfolio_summary(spark, sf):
    return portfolio.portfolio_summary(scored(spark, sf))


@query("top_anomalies", sql=ALL + """
SELECT asset_id, severity, round(anomaly_score, 6) AS anomaly_score FROM prio WHERE status = 'ACTIVE' AND n_windows > 0
ORDER BY prio.anomaly_score DESC, asset_id LIMIT 4""")
def top_anomalies(spark, sf):
    return rounded(portfolio.top_anomalies(scored(spark, sf)).select("asset_id", "severity", "anomaly_score"))


@query("portfolio_trend", sql=with_(MONTHLY) + """
SELECT period, round(sum(actual) / 1000, 2) AS actual_k, round(sum(expected) / 1000, 2) AS expected_k FROM monthly GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def portfolio_trend(spark, sf):
    return portfolio.portfolio_trend(b.monthly(spark, sf))


@query("breakdown_rollup", sql=ALL + """
SELECT basin, field_name, count(*) AS assets, round(sum(actual), 4) AS actual, round(sum(expected), 4) AS expected, round(avg(score), 4) AS mean_score,
  round(sum(recovery_volume), 4) AS recovery_volume, count(*) FILTER (WHERE severity <> 'NORMAL') AS flagged FROM prio GROUP BY ROLLUP (basin, field_name)""")
def breakdown_rollup(spark, sf):
    return rounded(portfolio.breakdown(scored(spark, sf)), 4)


@query("history_tail", sql=with_(TELEMETRY_RAW) + f"""
SELECT asset_id, CAST(timestamp AS DATE) AS day, production, l_orderkey, l_linenumber FROM telemetry_raw
QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC, {', '.join(c.strip() + ' DESC' for c in LINE_ORDER.split(','))}) <= 24""")
def history_tail(spark, sf):
    out = portfolio.history_tail(b.telemetry_raw(spark, sf), 24, ties=b.LINE_ORDER)
    return out.select("asset_id", F.to_date("timestamp").alias("day"), "production", "l_orderkey", "l_linenumber")


@query("asset_detail", sql=ALL + """
, tail AS (SELECT asset_id, period, actual, expected FROM monthly QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY period DESC) <= 24)
SELECT asset_id, priority, CAST(count(*) AS INTEGER) AS months, min(x.period) AS first_period, round(sum(x.actual), 4) AS actual_24 FROM prio p JOIN tail x USING (asset_id) GROUP BY 1, 2""")
def asset_detail(spark, sf):
    out = portfolio.asset_detail(scored(spark, sf), b.monthly(spark, sf))
    return rounded(out.select("asset_id", "priority", F.size("history").alias("months"), F.col("history")[0]["period"].alias("first_period"),
                              F.aggregate("history", F.lit(0.0), lambda a, h: a + h["actual"]).alias("actual_24")), 4)


@query("assets_view", sql=with_(ASSETS) + """
, reg AS (SELECT asset_id, field_name, basin, status FROM assets)
, cat AS (SELECT asset_id, concat('Unit ', asset_id) AS name, onstream_year FROM assets WHERE status = 'ACTIVE')
SELECT r.asset_id, field_name, basin, status, coalesce(name, concat_ws(' ', field_name, r.asset_id)) AS name, onstream_year
FROM reg r LEFT JOIN cat c ON c.asset_id = r.asset_id""")
def assets_view(spark, sf):
    a = b.assets(spark, sf)
    cat = a.where(F.col("status") == "ACTIVE").select("asset_id", F.concat(F.lit("Unit "), "asset_id").alias("name"), "onstream_year")
    return portfolio.assets_view(a.select("asset_id", "field_name", "basin", "status"), cat)


INTERV = """interv AS (SELECT l_returnflag AS kind, l_extendedprice AS predicted, l_extendedprice * (1 - l_discount * 4) * (1 + l_tax) AS actual,
  CASE WHEN l_linenumber <> 3 THEN l_linestatus = 'F' END AS success FROM lineitem)"""
IVCOLS = """count(*) AS n, round(avg(predicted), 4) AS mean_predicted, round(avg(actual), 4) AS mean_actual,
  round(count(*) FILTER (WHERE success) / nullif(count(success), 0)::DOUBLE, 6) AS success_rate,
  round(count(*) FILTER (WHERE abs(actual - predicted) <= 0.2::DOUBLE * abs(predicted)) / count(*)::DOUBLE, 6) AS hit_rate,
  round(sum(CASE WHEN predicted >= p80 THEN actual ELSE 0 END) / sum(actual), 6) AS top_fifth_capture"""


def interventions(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("predicted"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount") * 4) * (1 + F.col("l_tax"))).alias("actual"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linestatus") == "F").alias("success"))


def _effect(df):
    return df.select(*[c for c in df.columns if c in ("kind", "n")], F.round("mean_predicted", 4).alias("mean_predicted"),
                     F.round("mean_actual", 4).alias("mean_actual"), F.round("success_rate", 6).alias("success_rate"),
                     F.round("hit_rate", 6).alias("hit_rate"), F.round("top_fifth_capture", 6).alias("top_fifth_capture"))


@query("intervention_effect", sql=with_(INTERV) + f", p AS (SELECT quantile_cont(predicted, 0.8) AS p80 FROM interv) SELECT {IVCOLS} FROM interv, p")
def intervention_effect(spark, sf):
    return _effect(portfolio.intervention_effect(interventions(spark, sf)))


@query("intervention_effect_by_kind", sql=with_(INTERV) + f"""
, p AS (SELECT kind, quantile_cont(predicted, 0.8) AS p80 FROM interv GROUP BY 1) SELECT kind, {IVCOLS} FROM interv JOIN p USING (kind) GROUP BY 1""")
def intervention_effect_by_kind(spark, sf):
    return _effect(portfolio.intervention_effect(interventions(spark, sf), ["kind"]))


@query("sources_view", sql=with_(EVENTS) + """
SELECT DISTINCT source AS source_name, asset_id AS dataset_name, source_type, CASE source_type WHEN 'REAL' THEN 'Published measurements'
  WHEN 'SYNTHETIC' THEN 'Generated for demonstration; not measured' ELSE 'Model output; an estimate' END AS provenance_note FROM events_telemetry""")
def sources_view(spark, sf):
    src = b.events_telemetry(spark, sf).select(F.col("source").alias("source_name"), F.col("asset_id").alias("dataset_name"), "source_type").distinct()
    notes = {"REAL": "Published measurements", "SYNTHETIC": "Generated for demonstration; not measured", "DERIVED": "Model output; an estimate"}
    return portfolio.sources_view(src, notes)


MODELS = """models AS (SELECT concat('M-', CAST(p_partkey AS VARCHAR)) AS code, p_name AS model_name, CASE WHEN p_partkey % 5 = 0 THEN 'DEPRECATED' ELSE 'ACTIVE' END AS status,
  CASE WHEN p_partkey % 7 <> 0 THEN DATE '2026-01-01' END AS training_date, CAST(p_partkey % 3 AS INTEGER) AS metric_count FROM part)"""


def models(spark, sf):
    k = F.col("p_partkey")
    return b.table(spark, sf, "part").select(
        F.concat(F.lit("M-"), k.cast("string")).alias("code"), F.col("p_name").alias("model_name"),
        F.when(k % 5 == 0, "DEPRECATED").otherwise("ACTIVE").alias("status"),
        F.when(k % 7 != 0, F.lit("2026-01-01").cast("date")).alias("training_date"), (k % 3).cast("int").alias("metric_count"))


@query("validate_models", sql=with_(MODELS) + """
, r AS (SELECT *, CASE WHEN status <> 'ACTIVE' THEN concat('status is ', status) WHEN training_date IS NULL THEN 'never trained'
  WHEN metric_count <= 0 THEN 'no metrics' ELSE 'ok' END AS reason FROM models)
SELECT code, model_name, reason, reason = 'ok' AS valid FROM r""")
def validate_models(spark, sf):
    return portfolio.validate_models(models(spark, sf)).select("code", "model_name", "reason", "valid")


@query("models_view", sql=with_(MODELS) + " SELECT code, model_name, status FROM models WHERE contains(lower(model_name), 'ring')")
def models_view(spark, sf):
    return portfolio.models_view(models(spark, sf), name="Ring").select("code", "model_name", "status")


STATUS_EVENTS = """, ev AS (SELECT asset_id, CAST(date_trunc('month', timestamp) AS DATE) AS period, timestamp, l_orderkey, l_linenumber, l_partkey,
   l_quantity, l_extendedprice, l_discount, l_tax, ['ACKNOWLEDGED', 'INVESTIGATING', 'MONITORING', 'RESOLVED', 'FALSE_POSITIVE', 'DISMISSED', 'DONE'][l_linenumber] AS status FROM telemetry_raw)"""
VALID_STATUS = "('UNACKNOWLEDGED', 'ACKNOWLEDGED', 'INVESTIGATING', 'MONITORING', 'RESOLVED', 'FALSE_POSITIVE')"
OVERLAY = STATUS_EVENTS + f"""
, last_status AS (SELECT asset_id, period, status FROM ev WHERE status IN {VALID_STATUS}
   QUALIFY row_number() OVER (PARTITION BY asset_id, period ORDER BY timestamp DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) = 1)
, over AS (SELECT r.asset_id, r.period, r.anomaly_score, {SEV.format(s='r.anomaly_score')} AS severity, coalesce(s.status, 'UNACKNOWLEDGED') AS status
   FROM ruled r LEFT JOIN last_status s USING (asset_id, period) WHERE r.anomaly_score >= 0.5)"""


def status_frames(spark, sf):
    rows = b.telemetry_raw(spark, sf)
    names = F.array(*[F.lit(s) for s in ("ACKNOWLEDGED", "INVESTIGATING", "MONITORING", "RESOLVED", "FALSE_POSITIVE", "DISMISSED", "DONE")])
    events = rows.select("asset_id", F.to_date(F.date_trunc("month", "timestamp")).alias("period"), "timestamp", *b.LINE_ORDER,
                         F.element_at(names, F.col("l_linenumber")).alias("status"))
    return portfolio.apply_status_events(anomaly.detect_windows(ruled(spark, sf)), events, order=("timestamp", *b.LINE_ORDER))


@query("status_overlay", sql=with_(MONTHLY, TELEMETRY_RAW) + RULED + OVERLAY + " SELECT asset_id, period, severity, status FROM over")
def status_overlay(spark, sf):
    return status_frames(spark, sf)[0].select("asset_id", "period", "severity", "status")


@query("status_rejected", sql=with_(TELEMETRY_RAW) + STATUS_EVENTS + f" SELECT status, count(*) AS row_count FROM ev WHERE status NOT IN {VALID_STATUS} GROUP BY 1")
def status_rejected(spark, sf):
    return status_frames(spark, sf)[1].groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))


@query("filter_anomalies", sql=with_(MONTHLY, TELEMETRY_RAW) + RULED + OVERLAY + """
SELECT asset_id, period, severity, status FROM over WHERE severity IN ('ALERT', 'CRITICAL') AND status IN ('INVESTIGATING', 'MONITORING') AND contains(lower(asset_id), 'a-1')""")
def filter_anomalies(spark, sf):
    out = anomaly.filter_anomalies(status_frames(spark, sf)[0], ("ALERT", "CRITICAL"), ("INVESTIGATING", "MONITORING"), "A-1")
    return out.select("asset_id", "period", "severity", "status")


@query("deep_page", sql="""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders), n AS (SELECT CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM orders)
SELECT o_orderkey, place, pages FROM r, n WHERE place > (pages - 2) * 25 AND place <= (pages - 1) * 25""")
def deep_page(spark, sf):
    """The last page but one of all orders by price, from the stored pages."""
    place = scratch_path(spark, "pages")
    pages.store_pages(b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], place, 5000)
    index = pages.page_index(spark, place, 25)
    out = pages.read_page(spark, place, index.first()["pages"] - 1, 25)
    return out.join(F.broadcast(index.select("pages"))).select("o_orderkey", F.col("_place").alias("place"), "pages")
