"""Anomaly queries: forests built level by level in SQL as the oracle, calibration, windows and evaluation."""

from pyspark.sql import functions as F

from checks.base import ASSETS, MONTHLY, query, rounded, with_
from checks.features import AF
from checks.scoring import RULED, SEV, ruled
from fieldspark.config import ForestConfig
from fieldspark.functions.columns import blend_rule as blend
from fieldspark.operators import anomaly, features, iforest, intervals, metrics
from fieldspark.plans import bindings as b
from fieldspark.session import scratch_path

FEATS = ("actual", "dev_fraction", "rolling_mean", "change_rate")


def forest_ctes(source: str, row: str, feats, keyed: bool, trees: int, sample: int, seed: int = 42, corrected: bool = True) -> str:
    """CTEs `walk` (one row per row and tree: leaf depth, size, sampled flag) and `paths` (mean path per row)."""
    key = "asset_id, " if keyed else ""
    k = len(feats)
    x = "[" + ", ".join(f"{f}::DOUBLE" for f in feats) + "]"
    cols = f"{key}tree, rk, x, smp"
    parts = [f"""
, l0 AS MATERIALIZED (SELECT {cols}, 1::BIGINT AS node, 0 AS depth, NULL::BIGINT AS size FROM (
   SELECT *, row_number() OVER (PARTITION BY {key}tree ORDER BY md5(concat_ws(':', '{seed}', tree::VARCHAR, rk::VARCHAR)), rk) <= {sample} AS smp
   FROM (SELECT {key}{row} AS rk, {x} AS x FROM {source}) r CROSS JOIN (SELECT unnest(range(1, {trees + 1})) AS tree) tr) z)"""]
    depth = iforest.tree_depth(sample)
    for d in range(1, depth + 1):
        los = ", ".join(f"min(x[{j}]) FILTER (WHERE smp) OVER w AS lo{j}, max(x[{j}]) FILTER (WHERE smp) OVER w AS hi{j}" for j in range(1, k + 1))
        openl = ", ".join(f"CASE WHEN hi{j} > lo{j} THEN {j} END" for j in range(1, k + 1))
        lo = "[" + ", ".join(f"lo{j}" for j in range(1, k + 1)) + "]"
        hi = "[" + ", ".join(f"hi{j}" for j in range(1, k + 1)) + "]"
        u = "('0x' || substr(h, {p}, 8))::BIGINT / 4294967296.0::DOUBLE"
        parts.append(f"""
, l{d} AS MATERIALIZED (SELECT {cols},
   CASE WHEN j IS NULL THEN node WHEN x[j] < cutv THEN node * 2 ELSE node * 2 + 1 END AS node,
   CASE WHEN j IS NULL THEN depth ELSE depth + 1 END AS depth, CASE WHEN size IS NULL AND j IS NULL THEN n ELSE size END AS size
  FROM (SELECT *, lo[j] + ({u.format(p=9)}) * (hi[j] - lo[j]) AS cutv FROM (
   SELECT *, CASE WHEN size IS NULL AND n > 1 AND len(op) > 0 THEN op[CAST(floor(({u.format(p=1)}) * len(op)) AS INTEGER) + 1] END AS j FROM (
    SELECT *, list_filter([{openl}], lambda v: v IS NOT NULL) AS op, {lo} AS lo, {hi} AS hi,
      md5(concat_ws(':', '{seed}', {key}tree::VARCHAR, node::VARCHAR)) AS h FROM (
     SELECT *, count(*) FILTER (WHERE smp) OVER w AS n, {los} FROM l{d - 1} WINDOW w AS (PARTITION BY {key}tree, node)) a) b) c) e)""")
    harm = "2 * list_sum(list_transform(range(1, size), lambda i: 1.0::DOUBLE / i)) - 2 * (size - 1) / size::DOUBLE"
    extra = f"CASE WHEN size > 1 THEN {harm} ELSE 0 END" if corrected else "0"
    parts.append(f"""
, walk AS (SELECT {cols}, node, depth, coalesce(size, count(*) FILTER (WHERE smp) OVER (PARTITION BY {key}tree, node)) AS size FROM l{depth})
, paths AS (SELECT {key}rk, avg(depth + {extra}) AS path FROM walk GROUP BY ALL)
, psi AS (SELECT {key}count(*) AS psi FROM l0 WHERE smp AND tree = 1 GROUP BY ALL)""")
    return "".join(parts)


HARM_PSI = "(2 * list_sum(list_transform(range(1, psi), lambda i: 1.0::DOUBLE / i)) - 2 * (psi - 1) / psi::DOUBLE)"
SMALL = ForestConfig(trees=5, sample=256, seed=42)
SUB = ForestConfig(trees=5, sample=32, seed=7)
POOL = ForestConfig(trees=8, sample=128, seed=3, leaf_correction=False)
BASE = with_(MONTHLY) + AF
RAW = forest_ctes("af", "t", FEATS, True, 5, 256) + f"""
, raw AS (SELECT p.asset_id, rk AS t, round(power(2, -path / {HARM_PSI}), 12) AS raw_score FROM paths p JOIN psi USING (asset_id))"""


def feats(spark, sf):
    return features.anomaly_features(b.monthly(spark, sf))


def raw_scores(spark, sf, presample=False):
    grown = iforest.grow(feats(spark, sf), "t", FEATS, config=SMALL, presample=presample)
    return iforest.score_training(grown, "t", config=SMALL)


@query("iforest_leaves", sql=BASE + forest_ctes("af", "t", FEATS, True, 5, 256) + """
SELECT asset_id, CAST(tree AS INTEGER) AS tree, rk AS t, node, depth, size FROM walk""")
def iforest_leaves(spark, sf):
    grown = iforest.grow(feats(spark, sf), "t", FEATS, config=SMALL)
    return grown.select("asset_id", "tree", "t", "node", "depth", "size")


@query("iforest_scores", sql=BASE + RAW + " SELECT asset_id, t, round(raw_score, 6) AS raw_score FROM raw")
def iforest_scores(spark, sf):
    return rounded(raw_scores(spark, sf))


@query("iforest_unseen", sql=BASE + forest_ctes("af", "t", FEATS, True, 5, 32, 7) + f"""
SELECT p.asset_id, rk AS t, round(power(2, -path / {HARM_PSI}), 6) AS raw_score FROM paths p JOIN psi USING (asset_id)""")
def iforest_unseen(spark, sf):
    """Forests grown on 32 sampled months per asset; every month is scored through the packed trees."""
    rows = feats(spark, sf)
    forest = iforest.pack(iforest.grow_nodes(rows, "t", FEATS, config=SUB, presample=True), config=SUB)
    return rounded(iforest.score_rows(rows, forest, FEATS, config=SUB).select("asset_id", "t", "raw_score"))


ZS = ", ".join(f"({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1 ELSE stddev_pop({f}) OVER () END AS z_{f}" for f in FEATS)
ZPOOL = f", pool AS (SELECT asset_id, t, concat_ws('/', asset_id, t::VARCHAR) AS rkey, {ZS}, count(*) OVER () AS total FROM af)"


@query("iforest_pooled", sql=BASE + ZPOOL + forest_ctes("pool", "rkey", [f"z_{f}" for f in FEATS], False, 8, 128, 3, corrected=False) + """
SELECT pool.asset_id, pool.t, round(power(2, -path / (2 * (ln(total - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * (total - 1.0::DOUBLE) / total)), 6) AS raw_score
FROM paths JOIN pool ON rk = rkey""")
def iforest_pooled(spark, sf):
    rows = feats(spark, sf).withColumn("rkey", F.concat_ws("/", "asset_id", F.col("t").cast("string")))
    return rounded(anomaly.pooled_scores(rows, "rkey", FEATS, POOL).select("asset_id", "t", "raw_score"))


CAL = RAW + """
, cq AS (SELECT asset_id, quantile_cont(raw_score, 0.25) AS lo, quantile_cont(raw_score, 0.999) AS hi FROM raw GROUP BY 1)
, cal AS (SELECT r.asset_id, r.t, raw_score, power(least(greatest((raw_score - lo) / greatest((hi - lo) * 1.3::DOUBLE, 1e-9), 0), 1), 1.7::DOUBLE) AS iso_score
  FROM raw r JOIN cq USING (asset_id))
, bl AS (SELECT af.*, iso_score, greatest(iso_score, CASE WHEN abs(dev_fraction) >= 0.1::DOUBLE THEN least(abs(dev_fraction) / 0.2::DOUBLE, 1) ELSE 0 END) AS anomaly_score
  FROM af JOIN cal USING (asset_id, t))"""


# detector_scores uses all five features
RAW_ALL = forest_ctes("af", "t", anomaly.FEATURES, True, 5, 256) + f"""
, raw AS (SELECT p.asset_id, rk AS t, round(power(2, -path / {HARM_PSI}), 12) AS raw_score FROM paths p JOIN psi USING (asset_id))"""
CAL_ALL = CAL.replace(RAW, RAW_ALL)


@query("calibrated_scores", sql=BASE + CAL_ALL + " SELECT asset_id, t, round(iso_score, 6) AS iso_score, round(anomaly_score, 6) AS anomaly_score FROM bl")
def calibrated_scores(spark, sf):
    out = anomaly.detector_scores(b.monthly(spark, sf), SMALL)
    return rounded(out.select("asset_id", "t", "iso_score", "anomaly_score"))


def scored(spark, sf):
    return anomaly.detector_scores(b.monthly(spark, sf), SMALL)


# Months before the 48th fit the forest and its scale; the later ones only walk it.
RAW_EARLY = RAW_ALL.replace("<= 256 AS smp", "<= 256 AND rk < 48 AS smp")
CAL_EARLY = CAL.replace(RAW, RAW_EARLY).replace("FROM raw GROUP BY 1", "FROM raw WHERE t < 48 GROUP BY 1")


@query("detector_later_months", sql=BASE + CAL_EARLY + """
SELECT asset_id, t, round(iso_score, 6) AS iso_score, round(anomaly_score, 6) AS anomaly_score FROM bl WHERE t >= 48""")
def detector_later_months(spark, sf):
    """A detector that is fitted on the first months, stored, and scores the later ones on its own scale."""
    panel = b.monthly(spark, sf)
    place = scratch_path(spark, "detector")
    anomaly.fit_detector(panel.where(F.col("t") < 48), SMALL).write.parquet(place)
    out = anomaly.score_with(panel, spark.read.parquet(place), SMALL).where(F.col("t") >= 48)
    return rounded(out.select("asset_id", "t", "iso_score", "anomaly_score"))


@query("detector_default", sql=BASE + """
SELECT asset_id, count(*) AS months, count(*) AS scored, 0 AS out_of_range, 0 AS below_rule FROM af GROUP BY 1""")
def detector_default(spark, sf):
    """The detector as the library sets it (200 trees of 256 rows): every month has a score, in range and not below the rule."""
    out = anomaly.detector_scores(b.monthly(spark, sf))
    rule = F.when(F.abs("dev_fraction") >= 0.1, F.least(F.abs("dev_fraction") / 0.2, F.lit(1.0))).otherwise(0.0)
    return out.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("months"), F.count("iso_score").alias("scored"),
        F.count_if(~F.col("iso_score").between(0, 1) | ~F.col("anomaly_score").between(0, 1)).cast("int").alias("out_of_range"),
        F.count_if(F.col("anomaly_score") < rule - 1e-12).cast("int").alias("below_rule"))


@query("blend_rule", sql=with_(MONTHLY) + RULED + """
SELECT asset_id, period, round(greatest(least(abs(change_rate), 1), anomaly_score), 6) AS blended FROM ruled""")
def blend_rule(spark, sf):
    return rounded(feats(spark, sf).select(
        "asset_id", "period", blend(F.least(F.abs("change_rate"), F.lit(1.0)), F.col("dev_fraction")).alias("blended")))


WIN = f"""
, win AS (SELECT asset_id, period, t, anomaly_score, {SEV.format(s='anomaly_score')} AS severity, dev_fraction * 100 AS deviation_pct, expected, actual,
   dev_fraction, change_rate FROM bl WHERE anomaly_score >= 0.5)"""


@query("detect_windows", sql=BASE + CAL_ALL + WIN + """
SELECT asset_id, period, t, severity, round(anomaly_score, 6) AS anomaly_score, round(deviation_pct, 6) + 0.0::DOUBLE AS deviation_pct,
  round(expected, 6) AS expected, actual FROM win""")
def detect_windows(spark, sf):
    out = anomaly.detect_windows(scored(spark, sf))
    return rounded(out.select("asset_id", "period", "t", "severity", "anomaly_score", "deviation_pct", "expected", "actual"))


CONTRIB = """
, c AS (SELECT asset_id, period, round(least(abs(dev_fraction) / 0.2::DOUBLE, 1), 3) AS d, round(least(abs(change_rate) * 5, 1), 3) AS m FROM af)"""


@query("contributions", sql=BASE + CONTRIB + """
SELECT asset_id, period, CASE WHEN m > d THEN 'decline_rate' ELSE 'production_deviation' END AS top_feature, greatest(d, m) AS top_importance,
  least(d, m) AS second_importance FROM c""")
def contributions(spark, sf):
    out = feats(spark, sf).withColumn("c", anomaly.contributions(F.col("dev_fraction"), F.col("change_rate")))
    return out.select("asset_id", "period", F.col("c")[0]["feature"].alias("top_feature"),
                      F.col("c")[0]["importance"].alias("top_importance"), F.col("c")[1]["importance"].alias("second_importance"))


@query("latest_window", sql=BASE + CAL_ALL + WIN + """
SELECT asset_id, period, severity, round(anomaly_score, 6) AS anomaly_score FROM win QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY period DESC) = 1""")
def latest_window(spark, sf):
    out = anomaly.latest_window(anomaly.detect_windows(scored(spark, sf)))
    return rounded(out.select("asset_id", "period", "severity", "anomaly_score"))


@query("recent_windows", sql=BASE + CAL_ALL + WIN + """
, six AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY period DESC) <= 6)
SELECT asset_id, CAST(count(*) AS INTEGER) AS n_windows, string_agg(concat(period::VARCHAR, '=', severity), ',' ORDER BY period) AS windows FROM six GROUP BY 1""")
def recent_windows(spark, sf):
    out = anomaly.recent_windows(anomaly.detect_windows(scored(spark, sf)))
    return out.select("asset_id", "n_windows", F.array_join(F.transform(
        "windows", lambda w: F.concat(w["period"].cast("string"), F.lit("="), w["severity"])), ",").alias("windows"))


def eval_sql(score: str) -> str:
    return eval_ctes(score) + " SELECT * FROM per_asset"


def eval_ctes(score: str) -> str:
    return f"""
, lab AS (SELECT asset_id, abs(dev_fraction) >= 0.1::DOUBLE AS y, {score} >= 0.5 AS p, {score} AS s FROM bl)
, cf AS (SELECT asset_id, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp,
   count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM lab GROUP BY 1)
, au AS (SELECT a.asset_id, sum(CASE WHEN a.s > c.s THEN 1 WHEN a.s = c.s THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS roc_auc
   FROM lab a JOIN lab c ON a.asset_id = c.asset_id AND a.y AND NOT c.y GROUP BY 1)
, per_asset AS (SELECT asset_id, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
  round(coalesce(roc_auc, 0.5), 6) AS roc_auc FROM cf LEFT JOIN au USING (asset_id))"""


EVALS = ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "roc_auc")


@query("evaluate_detector", sql=BASE + CAL_ALL + eval_sql("anomaly_score"))
def evaluate_detector(spark, sf):
    return rounded(anomaly.evaluate_detector(scored(spark, sf)).select("asset_id", *EVALS))


@query("evaluate_detector_unblended", sql=BASE + CAL_ALL + eval_sql("iso_score"))
def evaluate_detector_unblended(spark, sf):
    return rounded(anomaly.evaluate_detector(scored(spark, sf), score="iso_score").select("asset_id", *EVALS))


@query("feature_deviation_rank", sql=BASE + ZPOOL + ", long AS (" + " UNION ALL ".join(
    f"SELECT asset_id, t, '{f}' AS feature, {i} AS pos, z_{f} AS z FROM pool" for i, f in enumerate(FEATS)) + """)
SELECT asset_id, t, feature, round(z, 6) + 0.0::DOUBLE AS deviation_from_mean,
  CAST(row_number() OVER (PARTITION BY asset_id, t ORDER BY abs(z) DESC, pos) AS INTEGER) AS rank FROM long""")
def feature_deviation_rank(spark, sf):
    z = anomaly.standardise(feats(spark, sf), FEATS)
    return rounded(anomaly.feature_deviation_rank(z, ["asset_id", "t"], FEATS))


#: The texts of this query; the library gives bands and features alone.
EXPLAINED = (("WATCH", "Slight deviation in ", "; keep watching."), ("ALERT", "Notable deviation in ", "; look into it."),
             ("CRITICAL", "Strong deviation in ", "; needs attention now."))


@query("explain", sql=BASE + ZPOOL + ", long AS (" + " UNION ALL ".join(
    f"SELECT asset_id, t, '{f}' AS feature, {i} AS pos, z_{f} AS z FROM pool" for i, f in enumerate(FEATS)) + """)
, names AS (SELECT asset_id, t, coalesce(string_agg(feature, ', ' ORDER BY abs(z) DESC, pos) FILTER (WHERE abs(z) > 1.5), 'several measures') AS names FROM long GROUP BY 1, 2)
, s AS (SELECT asset_id, t, CASE WHEN abs(dev_fraction) >= 0.1::DOUBLE THEN least(abs(dev_fraction) / 0.2::DOUBLE, 1) ELSE 0 END AS s FROM af)
SELECT asset_id, t, CASE WHEN s >= 0.85::DOUBLE THEN concat('Strong deviation in ', names, '; needs attention now.') WHEN s >= 0.7::DOUBLE THEN concat('Notable deviation in ', names, '; look into it.')
  WHEN s >= 0.5 THEN concat('Slight deviation in ', names, '; keep watching.') ELSE 'Within the usual operating range.' END AS explanation FROM names JOIN s USING (asset_id, t)""")
def explain(spark, sf):
    z = anomaly.standardise(ruled(spark, sf), FEATS)
    out = z.withColumn("e", anomaly.explain(F.col("anomaly_score"), {f: F.col(f"z_{f}") for f in FEATS}))
    names = F.when(F.size("e.features") > 0, F.array_join("e.features", ", ")).otherwise("several measures")
    text = F.lit("Within the usual operating range.")
    for band, before, after in EXPLAINED:
        text = F.when(F.col("e.severity") == band, F.concat(F.lit(before), names, F.lit(after))).otherwise(text)
    return out.select("asset_id", "t", text.alias("explanation"))


KNOWN = """
, known AS (SELECT concat('A-', CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR)) AS asset_id, CAST(o_orderkey % 80 AS DOUBLE) AS start,
   CAST(o_orderkey % 80 + o_custkey % 3 AS DOUBLE) AS end_t FROM orders WHERE o_orderpriority = '1-URGENT')"""


def known_intervals(spark, sf):
    n = F.lit(b.table(spark, sf, "supplier").count())
    return b.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.concat(F.lit("A-"), (F.col("o_custkey") % n).cast("string")).alias("asset_id"),
        (F.col("o_orderkey") % 80).cast("double").alias("start"), (F.col("o_orderkey") % 80 + F.col("o_custkey") % 3).cast("double").alias("end"))


@query("interval_cover", sql=with_(MONTHLY) + KNOWN + """
SELECT m.asset_id, m.t, EXISTS (SELECT 1 FROM known k WHERE k.asset_id = m.asset_id AND m.t BETWEEN k.start AND k.end_t) AS covered FROM monthly m""")
def interval_cover(spark, sf):
    out = intervals.mark_covered(b.monthly(spark, sf), known_intervals(spark, sf), ("asset_id",), "t", "start", "end", 16.0)
    return out.select("asset_id", "t", "covered")


@query("interval_eval", sql=with_(MONTHLY) + RULED + KNOWN + """
, lab AS (SELECT r.anomaly_score AS s, EXISTS (SELECT 1 FROM known k WHERE k.asset_id = r.asset_id AND r.t BETWEEN k.start AND k.end_t) AS y FROM ruled r)
, st AS (SELECT i, i / 50::DOUBLE AS thr FROM (SELECT unnest(range(51)) AS i) x)
, pts AS (SELECT i, count(*) FILTER (WHERE y AND s >= thr) / (count(*) FILTER (WHERE y))::DOUBLE AS tpr, count(*) FILTER (WHERE NOT y AND s >= thr) / (count(*) FILTER (WHERE NOT y))::DOUBLE AS fpr FROM lab CROSS JOIN st GROUP BY 1)
, seg AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM pts WINDOW w AS (ORDER BY fpr, i))
, c AS (SELECT count(*) FILTER (WHERE y AND s >= 0.7) AS tp, count(*) FILTER (WHERE NOT y AND s >= 0.7) AS fp, count(*) FILTER (WHERE y AND s < 0.7) AS fn, count(*) FILTER (WHERE NOT y AND s < 0.7) AS tn FROM lab)
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(fp / (fp + tn)::DOUBLE, 6) AS false_positive_rate,
  round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((SELECT sum(a) FROM seg), 6) AS roc_auc FROM c""")
def interval_eval(spark, sf):
    return rounded(anomaly.evaluate_intervals(ruled(spark, sf), known_intervals(spark, sf)))


@query("active_anomalies", sql=with_(MONTHLY, ASSETS) + RULED + f"""
, lw AS (SELECT asset_id, period, anomaly_score, {SEV.format(s='anomaly_score')} AS severity FROM ruled WHERE anomaly_score >= 0.5
  QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY period DESC) = 1)
SELECT asset_id, basin, period, severity, round(anomaly_score, 6) AS anomaly_score FROM lw JOIN assets USING (asset_id)""")
def active_anomalies(spark, sf):
    latest = anomaly.latest_window(anomaly.detect_windows(ruled(spark, sf)))
    return rounded(anomaly.active_anomalies(latest, b.assets(spark, sf)).select("asset_id", "basin", "period", "severity", "anomaly_score"))


@query("list_anomalies", sql=with_(MONTHLY) + RULED + """
SELECT asset_id, period, round(anomaly_score, 6) AS anomaly_score FROM ruled WHERE anomaly_score >= 0.5""")
def list_anomalies(spark, sf):
    events = anomaly.detect_windows(ruled(spark, sf))
    return rounded(anomaly.list_anomalies(events).select("asset_id", "period", "anomaly_score"))


@query("portfolio_anomaly_metrics", sql=BASE + CAL_ALL + eval_ctes("anomaly_score") + """
SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, round(avg(roc_auc), 4) AS roc_auc,
  round(avg(accuracy), 4) AS accuracy, CAST(sum(tp + fp + fn + tn) AS BIGINT) AS sample_count, count(*) AS assets FROM per_asset""")
def portfolio_anomaly_metrics(spark, sf):
    return metrics.portfolio_anomaly_metrics(anomaly.evaluate_detector(scored(spark, sf)))
