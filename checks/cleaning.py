"""Cleaning, mapping and quality queries on the order-line and event telemetry."""

from pyspark.sql import functions as F

from checks.base import (
    ASSETS, EVENTS, LINE_ORDER, LINE_ORDER_DESC, TELEMETRY_RAW, query, rounded, with_,
)
from fieldspark.config import CleanConfig
from fieldspark.operators import clean, quality
from fieldspark.plans import bindings as b
from fieldspark.schema import ASSET_RULES, MEASURES, STANDARD, TELEMETRY_RULES
from fieldspark.sources import mapping

KEEP = ("l_orderkey", "l_linenumber", "l_partkey")
BOUNDS_OK = """production BETWEEN 0 AND 2000000 AND (pressure IS NULL OR pressure BETWEEN 0 AND 1500)
 AND (temperature IS NULL OR temperature BETWEEN -50 AND 300) AND (flow_rate IS NULL OR flow_rate BETWEEN 0 AND 5000000)"""
REQUIRED_OK = "asset_id IS NOT NULL AND trim(asset_id) <> '' AND timestamp IS NOT NULL AND production IS NOT NULL"
DEDUPED = f"""deduped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY {LINE_ORDER_DESC}) AS rn
                 FROM valid) x WHERE rn = 1)"""
VALID = f"valid AS (SELECT * FROM telemetry_raw WHERE {REQUIRED_OK} AND production >= 0 AND {BOUNDS_OK})"


def _day(df):
    return df.withColumn("day", F.to_date("timestamp")).drop("timestamp")


@query("map_telemetry", sql="""
WITH m AS (
  SELECT trim(concat(' C-', CAST(o_custkey AS VARCHAR), ' ')) AS asset_id, CAST(o_orderdate AS DATE) AS day,
    TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS production,
    nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END), '') AS source,
    'REAL' AS source_type, o_totalprice AS pressure, NULL::DOUBLE AS temperature, NULL::DOUBLE AS flow_rate,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS valve_status
  FROM orders)
SELECT asset_id, day, round(production, 4) AS production, source, source_type, round(pressure, 4) AS pressure,
  temperature, flow_rate, valve_status FROM m""")
def map_telemetry(spark, sf):
    raw = b.table(spark, sf, "orders").select(
        F.concat(F.lit(" C-"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("Well Code"),
        F.col("o_orderdate").cast("string").alias("Reporting Date"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("Oil Rate (bbl/d)"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("Publisher"),
        F.col("o_totalprice").cast("string").alias("Pressure-Bar"),
        F.when(F.col("o_orderstatus") == "O", "NaN").otherwise(F.col("o_orderstatus")).alias("Valve State"))
    return rounded(_day(mapping.to_telemetry(raw, source_type="real")), 4)


@query("map_provenance_tagged", sql=with_(TELEMETRY_RAW) + """
SELECT coalesce(source_type, 'REAL') AS source_type, source_type IN ('REAL','SYNTHETIC','DERIVED') AS ok,
  count(*) AS row_count FROM telemetry_raw GROUP BY 1, 2""")
def map_provenance_tagged(spark, sf):
    good, bad = mapping.split_provenance(mapping.to_telemetry(b.telemetry_raw(spark, sf), source_type="REAL", strict=False))
    tagged = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return tagged.groupBy("source_type", "ok").agg(F.count(F.lit(1)).alias("row_count"))


@query("normalize_ts", sql="""
SELECT count(*) AS row_count, count(ts) AS readable, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
FROM (SELECT TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'not a time' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS ts FROM events) x""")
def normalize_ts(spark, sf):
    text = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.col("timestamp").cast("string"))
    out = clean.normalize_ts(b.events_telemetry(spark, sf).withColumn("timestamp", text))
    return out.agg(F.count(F.lit(1)).alias("row_count"), F.count("timestamp").alias("readable"),
                   F.to_date(F.min("timestamp")).alias("first_day"), F.to_date(F.max("timestamp")).alias("last_day"))


@query("drop_missing_required", sql=with_(EVENTS) + """
, gaps AS (SELECT CASE WHEN event_id % 13 = 0 THEN ' ' ELSE asset_id END AS asset_id,
   CASE WHEN event_id % 17 = 0 THEN NULL ELSE production END AS production, source_type FROM events_telemetry)
SELECT source_type, count(*) AS row_count FROM gaps WHERE trim(asset_id) <> '' AND production IS NOT NULL GROUP BY 1""")
def drop_missing_required(spark, sf):
    ev = b.events_telemetry(spark, sf).withColumns({
        "asset_id": F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("asset_id")),
        "production": F.when(F.col("event_id") % 17 != 0, F.col("production"))})
    return clean.drop_missing_required(ev).groupBy("source_type").agg(F.count(F.lit(1)).alias("row_count"))


@query("convert_units", sql=with_(TELEMETRY_RAW) + """
SELECT asset_id, l_orderkey, l_linenumber, l_partkey, round(pressure * 0.0689476, 6) AS pressure,
  round(temperature * 0.5, 6) AS temperature FROM telemetry_raw""")
def convert_units(spark, sf):
    out = clean.convert_units(b.telemetry_raw(spark, sf), {"pressure": ("psi", 0.0689476), "temperature": ("half", 0.5)})
    return rounded(out.select("asset_id", *KEEP, "pressure", "temperature"))


@query("enforce_positive", sql=with_(EVENTS) + """
, shifted AS (SELECT source_type, production - 60 AS p FROM events_telemetry)
SELECT source_type, count(*) FILTER (WHERE p >= 0) AS strict_rows, count(*) AS lenient_rows,
  round(sum(CASE WHEN p < 0 THEN 0 ELSE p END), 4) AS lenient_sum FROM shifted GROUP BY 1""")
def enforce_positive(spark, sf):
    ev = b.events_telemetry(spark, sf).withColumn("production", F.col("production") - 60)
    strict = clean.enforce_positive(ev).groupBy("source_type").agg(F.count(F.lit(1)).alias("strict_rows"))
    soft = clean.enforce_positive(ev, strict=False).groupBy("source_type").agg(
        F.count(F.lit(1)).alias("lenient_rows"), F.sum("production").alias("lenient_sum"))
    return rounded(soft.join(strict, "source_type"), 4)


@query("unit_violations", sql=with_(TELEMETRY_RAW) + f"""
SELECT count(*) FILTER (WHERE NOT production BETWEEN 0 AND 2000000) AS production_violations,
  count(*) FILTER (WHERE NOT pressure BETWEEN 0 AND 1500) AS pressure_violations,
  count(*) FILTER (WHERE NOT temperature BETWEEN -50 AND 300) AS temperature_violations,
  count(*) FILTER (WHERE NOT flow_rate BETWEEN 0 AND 5000000) AS flow_rate_violations,
  count(*) FILTER (WHERE NOT ({BOUNDS_OK})) AS rows_dropped FROM telemetry_raw""")
def unit_violations(spark, sf):
    return clean.unit_violations(b.telemetry_raw(spark, sf))


@query("validate_units", sql=with_(TELEMETRY_RAW) + f"""
SELECT asset_id, count(*) AS kept FROM telemetry_raw WHERE {BOUNDS_OK} GROUP BY 1""")
def validate_units(spark, sf):
    return clean.validate_units(b.telemetry_raw(spark, sf)).groupBy("asset_id").agg(F.count(F.lit(1)).alias("kept"))


def _dedupe_sql(order: str) -> str:
    return with_(TELEMETRY_RAW) + f"""
SELECT asset_id, CAST(timestamp AS DATE) AS day, production, l_orderkey, l_linenumber, l_partkey, source, source_type
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY {order}) AS rn FROM telemetry_raw) x
WHERE rn = 1"""


@query("dedupe_last", sql=_dedupe_sql(LINE_ORDER_DESC))
def dedupe_last(spark, sf):
    out = clean.dedupe(b.telemetry_raw(spark, sf), b.LINE_ORDER)
    return _day(out).select("asset_id", "day", "production", *KEEP, "source", "source_type")


@query("dedupe_first", sql=_dedupe_sql(LINE_ORDER))
def dedupe_first(spark, sf):
    out = clean.dedupe(b.telemetry_raw(spark, sf), b.LINE_ORDER, keep="first")
    return _day(out).select("asset_id", "day", "production", *KEEP, "source", "source_type")


@query("missingness", sql=with_(TELEMETRY_RAW) + " ".join(
    f"{'UNION ALL' if i else ''} SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM telemetry_raw"
    for i, c in enumerate(STANDARD)))
def missingness(spark, sf):
    return quality.missingness(b.telemetry_raw(spark, sf))


@query("impute_time", sql=with_(EVENTS) + """
, g AS (SELECT *, bool_or(source_type = 'REAL') OVER (PARTITION BY asset_id) AS is_real,
   epoch_us(timestamp)::DOUBLE AS e FROM events_telemetry)
, n AS (SELECT *,
   last_value(CASE WHEN pressure IS NOT NULL THEN e END IGNORE NULLS) OVER w1 AS pe,
   last_value(pressure IGNORE NULLS) OVER w1 AS pv,
   first_value(CASE WHEN pressure IS NOT NULL THEN e END IGNORE NULLS) OVER w2 AS ne,
   first_value(pressure IGNORE NULLS) OVER w2 AS nv
  FROM g WINDOW w1 AS (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   w2 AS (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT asset_id, event_id, source_type, round(CASE WHEN pressure IS NOT NULL OR is_real THEN pressure
  WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((e - pe) / (ne - pe)) END, 6) AS pressure FROM n""")
def impute_time(spark, sf):
    out = clean.impute_time(b.events_telemetry(spark, sf), slice_unit="day")
    return rounded(out.select("asset_id", "event_id", "source_type", "pressure"))


@query("contract_violations", sql=with_(TELEMETRY_RAW) + """
, bent AS (SELECT CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE asset_id END AS asset_id, timestamp,
   CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE production END AS production,
   CASE WHEN l_linenumber = 7 THEN 'GUESSED' ELSE source_type END AS source_type,
   CASE WHEN l_linenumber = 6 THEN 'AJAR' ELSE valve_status END AS valve_status FROM telemetry_raw)
SELECT 'asset_id_missing' AS rule, count(*) FILTER (WHERE asset_id IS NULL OR length(trim(asset_id)) = 0) AS violations FROM bent
UNION ALL SELECT 'asset_id_too_long', count(*) FILTER (WHERE length(asset_id) > 32) FROM bent
UNION ALL SELECT 'timestamp_missing', count(*) FILTER (WHERE timestamp IS NULL) FROM bent
UNION ALL SELECT 'production_missing', count(*) FILTER (WHERE production IS NULL) FROM bent
UNION ALL SELECT 'source_type_invalid', count(*) FILTER (WHERE source_type NOT IN ('REAL','SYNTHETIC','DERIVED')) FROM bent
UNION ALL SELECT 'valve_status_invalid', count(*) FILTER (WHERE valve_status NOT IN ('OPEN','CLOSED','THROTTLED','UNKNOWN')) FROM bent""")
def contract_violations(spark, sf):
    return quality.contract_counts(_bent(spark, sf), TELEMETRY_RULES)


def _bent(spark, sf):
    return b.telemetry_raw(spark, sf).withColumns({
        "asset_id": F.when(F.col("l_orderkey") % 19 != 0, F.col("asset_id")),
        "production": F.when(F.col("l_orderkey") % 23 != 0, F.col("production")),
        "source_type": F.when(F.col("l_linenumber") == 7, "GUESSED").otherwise(F.col("source_type")),
        "valve_status": F.when(F.col("l_linenumber") == 6, "AJAR").otherwise(F.col("valve_status"))})


@query("contract_quarantine", sql=with_(TELEMETRY_RAW) + """
, bent AS (SELECT CASE WHEN l_orderkey % 19 = 0 THEN 'asset_id_missing' END AS r1,
   CASE WHEN l_orderkey % 23 = 0 THEN 'production_missing' END AS r2,
   CASE WHEN l_linenumber = 7 THEN 'source_type_invalid' END AS r3,
   CASE WHEN l_linenumber = 6 THEN 'valve_status_invalid' END AS r4 FROM telemetry_raw)
SELECT concat_ws(',', r1, r2, r3, r4) AS reasons, count(*) AS row_count FROM bent GROUP BY 1""")
def contract_quarantine(spark, sf):
    good, bad = quality.check_contract(_bent(spark, sf), TELEMETRY_RULES)
    both = good.select(F.lit("").alias("reasons")).unionByName(bad.select(F.array_join("reasons", ",").alias("reasons")))
    return both.groupBy("reasons").agg(F.count(F.lit(1)).alias("row_count"))


@query("validate_asset_columns", sql=with_(ASSETS) + """
, geo AS (SELECT asset_id, qi * 10 - 2600 AS latitude, qi - 200 AS longitude, qi, di, b * 3 AS b FROM assets)
SELECT asset_id, concat_ws(',', CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude_out_of_range' END,
  CASE WHEN b NOT BETWEEN 0 AND 2 THEN 'exponent_out_of_range' END) AS reasons FROM geo
WHERE latitude NOT BETWEEN -90 AND 90 OR b NOT BETWEEN 0 AND 2""")
def validate_asset_columns(spark, sf):
    geo = b.assets(spark, sf).withColumns({
        "latitude": F.col("qi") * 10 - 2600, "longitude": F.col("qi") - 200, "b": F.col("b") * 3})
    _, bad = quality.check_contract(geo, ASSET_RULES)
    return bad.select("asset_id", F.array_join("reasons", ",").alias("reasons"))


MAD_SQL = """
, m AS (SELECT asset_id, median(production) AS med, stddev_pop(production) AS sd, min(production) AS lo, max(production) AS hi
        FROM {src} GROUP BY 1)
, d AS (SELECT e.*, abs(production - med) AS dev, sd, lo, hi FROM {src} e JOIN m USING (asset_id))
, q AS (SELECT asset_id, median(dev) AS mad FROM d GROUP BY 1)
, flagged AS (SELECT d.*, coalesce(CASE WHEN mad > 0 THEN 0.6745::DOUBLE * dev / mad > 3.5
     WHEN hi > lo AND sd > 0 THEN dev / sd > 3.5 END, false) AS is_outlier FROM d JOIN q USING (asset_id))"""


@query("outliers_mad", sql=with_(EVENTS) + MAD_SQL.format(src="events_telemetry") + """
SELECT asset_id, event_id, is_outlier FROM flagged""")
def outliers_mad(spark, sf):
    return clean.outlier_flags(b.events_telemetry(spark, sf)).select("asset_id", "event_id", "is_outlier")


@query("outliers_mad_fallback", sql=with_(EVENTS) + """
, sparse AS (SELECT asset_id, event_id, CASE WHEN event_id % 5 = 0 THEN production ELSE 7 END AS production FROM events_telemetry)"""
       + MAD_SQL.format(src="sparse") + "SELECT asset_id, event_id, is_outlier FROM flagged")
def outliers_mad_fallback(spark, sf):
    sparse = b.events_telemetry(spark, sf).withColumn(
        "production", F.when(F.col("event_id") % 5 == 0, F.col("production")).otherwise(7.0))
    return clean.outlier_flags(sparse).select("asset_id", "event_id", "is_outlier")


@query("outliers_iqr", sql=with_(EVENTS) + """
, q AS (SELECT asset_id, quantile_cont(production, 0.25) AS q1, quantile_cont(production, 0.75) AS q3 FROM events_telemetry GROUP BY 1)
SELECT asset_id, event_id, production < q1 - 3 * (q3 - q1) OR production > q3 + 3 * (q3 - q1) AS is_outlier
FROM events_telemetry JOIN q USING (asset_id)""")
def outliers_iqr(spark, sf):
    return clean.outlier_flags(b.events_telemetry(spark, sf), "iqr").select("asset_id", "event_id", "is_outlier")


@query("drop_outliers", sql=with_(EVENTS) + MAD_SQL.format(src="events_telemetry") + """
SELECT asset_id, count(*) AS kept, round(sum(production), 4) AS production FROM flagged WHERE NOT is_outlier GROUP BY 1""")
def drop_outliers(spark, sf):
    kept = clean.drop_outliers(clean.outlier_flags(b.events_telemetry(spark, sf)))
    return rounded(kept.groupBy("asset_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("production").alias("production")), 4)


RESAMPLE = """SELECT asset_id, CAST(date_trunc('month', timestamp) AS DATE) AS month, avg(production) AS production,
  avg(pressure) AS pressure, avg(temperature) AS temperature, avg(flow_rate) AS flow_rate, count(*) AS sample_count,
  min(production) AS production_min, max(production) AS production_max,
  arg_min(valve_status, timestamp) FILTER (WHERE valve_status IS NOT NULL) AS valve_status,
  arg_min(source, timestamp) FILTER (WHERE source IS NOT NULL) AS source, arg_min(source_type, timestamp) AS source_type
FROM {src} GROUP BY 1, 2"""
RESAMPLE_ROUND = """SELECT asset_id, month, round(production, 6) AS production, round(pressure, 6) AS pressure,
  round(temperature, 6) AS temperature, round(flow_rate, 6) AS flow_rate, sample_count, production_min, production_max,
  valve_status, source, source_type FROM r"""


def _month(df):
    return rounded(df.withColumn("month", F.to_date("timestamp")).drop("timestamp"))


@query("resample_monthly", sql=with_(TELEMETRY_RAW, "valid AS (SELECT * FROM telemetry_raw)", DEDUPED)
       + f", r AS ({RESAMPLE.format(src='deduped')}) {RESAMPLE_ROUND}")
def resample_monthly(spark, sf):
    return _month(clean.resample_monthly(clean.dedupe(b.telemetry_raw(spark, sf), b.LINE_ORDER)))


@query("clean_full", sql=with_(TELEMETRY_RAW, VALID, DEDUPED) + MAD_SQL.format(src="deduped")
       + f", kept AS (SELECT * FROM flagged WHERE NOT is_outlier), r AS ({RESAMPLE.format(src='kept')}) {RESAMPLE_ROUND}")
def clean_full(spark, sf):
    out, _ = clean.clean(b.telemetry_raw(spark, sf), b.LINE_ORDER, CleanConfig(monthly=True))
    return _month(out)


@query("clean_rows", sql=with_(TELEMETRY_RAW, VALID, DEDUPED) + MAD_SQL.format(src="deduped") + """
SELECT asset_id, CAST(timestamp AS DATE) AS day, production, round(pressure, 6) AS pressure, source_type, valve_status
FROM flagged WHERE NOT is_outlier""")
def clean_rows(spark, sf):
    out, _ = clean.clean(b.telemetry_raw(spark, sf), b.LINE_ORDER)
    return rounded(_day(out).select("asset_id", "day", "production", "pressure", "source_type", "valve_status"))


MISS = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}" for c in STANDARD)


@query("quality_report", sql=with_(TELEMETRY_RAW) + f"""
SELECT count(*) AS number_of_rows, count(DISTINCT asset_id) AS assets, CAST(min(timestamp) AS DATE) AS first_day,
  CAST(max(timestamp) AS DATE) AS last_day,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT asset_id, timestamp FROM telemetry_raw) x) AS BIGINT) AS duplicate_count,
  {MISS} FROM telemetry_raw""")
def quality_report(spark, sf):
    out = quality.quality_report(b.telemetry_raw(spark, sf))
    return out.withColumns({"first_day": F.to_date("first_ts"), "last_day": F.to_date("last_ts")}).drop("first_ts", "last_ts")


@query("quality_distributions", sql=with_(TELEMETRY_RAW) + """
SELECT 'source' AS dimension, coalesce(source, '(none)') AS label, count(*) AS row_count FROM telemetry_raw GROUP BY 1, 2
UNION ALL SELECT 'source_type', source_type, count(*) FROM telemetry_raw GROUP BY 1, 2""")
def quality_distributions(spark, sf):
    return quality.distributions(b.telemetry_raw(spark, sf))


@query("store_quality", sql=with_(TELEMETRY_RAW, ASSETS) + " SELECT metric, CAST(value AS BIGINT) AS value FROM ("
       "SELECT 'number_of_rows' AS metric, count(*) AS value FROM telemetry_raw"
       " UNION ALL SELECT 'assets', count(DISTINCT asset_id) FROM telemetry_raw"
       " UNION ALL SELECT 'duplicate_count', count(*) - count(DISTINCT (asset_id, timestamp)) FROM telemetry_raw"
       + "".join(f" UNION ALL SELECT 'missing_{c}', count(*) FILTER (WHERE {c} IS NULL) FROM telemetry_raw" for c in STANDARD)
       + " UNION ALL SELECT 'registered_assets', count(*) FROM assets UNION ALL SELECT 'forecasts', count(*) FROM orders"
         " UNION ALL SELECT 'anomalies', count(*) FROM events) q")
def store_quality(spark, sf):
    facts = {"forecasts": b.table(spark, sf, "orders"), "anomalies": b.table(spark, sf, "events")}
    return quality.store_quality(b.telemetry_raw(spark, sf), b.assets(spark, sf), facts)


@query("provenance_summary", sql=with_(TELEMETRY_RAW) + """
SELECT source_type, count(*) AS row_count, round(count(*) / (sum(count(*)) OVER ())::DOUBLE * 100.0, 1) AS percentage
FROM telemetry_raw GROUP BY 1""")
def provenance_summary(spark, sf):
    return quality.provenance_summary(b.telemetry_raw(spark, sf))


@query("provenance_label", sql=with_(EVENTS, TELEMETRY_RAW) + """
, u AS (SELECT asset_id, source_type FROM events_telemetry UNION ALL SELECT asset_id, source_type FROM telemetry_raw)
SELECT asset_id, CASE WHEN count(DISTINCT source_type) = 1 AND min(source_type) IN ('REAL', 'DERIVED')
  THEN min(source_type) ELSE 'SYNTHETIC' END AS provenance FROM u GROUP BY 1""")
def provenance_label(spark, sf):
    cols = ("asset_id", "source_type")
    return quality.provenance_label(
        b.events_telemetry(spark, sf).select(*cols).unionByName(b.telemetry_raw(spark, sf).select(*cols)))


@query("clean_monthly", sql=with_(TELEMETRY_RAW) + f"""
, one AS (SELECT asset_id, CAST(date_trunc('month', timestamp) AS DATE) AS period, production AS actual,
    row_number() OVER (PARTITION BY asset_id, date_trunc('month', timestamp) ORDER BY timestamp DESC, {LINE_ORDER_DESC}) AS rn
  FROM telemetry_raw WHERE production >= 0)
SELECT asset_id, period, actual, round(avg(actual) OVER (PARTITION BY asset_id ORDER BY period
  ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS expected FROM one WHERE rn = 1""")
def clean_monthly(spark, sf):
    rows = b.telemetry_raw(spark, sf).withColumns({
        "period": F.to_date(F.date_trunc("month", "timestamp")), "actual": F.col("production")})
    out = clean.clean_monthly(rows, ("timestamp", *b.LINE_ORDER))
    return rounded(out.select("asset_id", "period", "actual", "expected"))


@query("chrono_split", sql=with_(TELEMETRY_RAW) + f"""
, n AS (SELECT asset_id, l_orderkey, l_linenumber, l_partkey,
    row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, {LINE_ORDER}) AS rn,
    count(*) OVER (PARTITION BY asset_id) AS n FROM telemetry_raw)
SELECT asset_id, l_orderkey, l_linenumber, l_partkey, CASE WHEN rn <= CASE WHEN n > 1 THEN
  least(greatest(floor(n * 0.8::DOUBLE), 1), n - 1) ELSE n END THEN 'train' ELSE 'test' END AS split FROM n""")
def chrono_split(spark, sf):
    out = clean.chrono_split(b.telemetry_raw(spark, sf), 0.8, ("timestamp", *b.LINE_ORDER))
    return out.select("asset_id", *KEEP, "split")


@query("data_checks", sql=with_(TELEMETRY_RAW, ASSETS) + """
, active_assets AS (SELECT * FROM assets WHERE status = 'ACTIVE')
SELECT 'future_timestamp' AS check_name, count(*) FILTER (WHERE timestamp > TIMESTAMP '1998-06-01') AS violations FROM telemetry_raw
UNION ALL SELECT 'not_positive', count(*) FILTER (WHERE production <= 0) FROM telemetry_raw
UNION ALL SELECT 'bad_provenance', count(*) FILTER (WHERE source_type NOT IN ('REAL','SYNTHETIC','DERIVED')) FROM telemetry_raw
UNION ALL SELECT 'duplicate_key', CAST(count(*) - count(DISTINCT (asset_id, timestamp)) AS BIGINT) FROM telemetry_raw
UNION ALL SELECT 'unknown_asset', count(*) FROM telemetry_raw WHERE asset_id NOT IN (SELECT asset_id FROM active_assets)""")
def data_checks(spark, sf):
    active = b.assets(spark, sf).where(F.col("status") == "ACTIVE")
    return quality.run_checks(b.telemetry_raw(spark, sf), active, F.lit("1998-06-01").cast("timestamp"))


@query("out_of_order", sql=with_(EVENTS) + """
, a AS (SELECT asset_id, timestamp, lag(timestamp) OVER (PARTITION BY asset_id ORDER BY event_id) AS prev FROM events_telemetry)
SELECT asset_id, count(*) FILTER (WHERE timestamp < prev) AS out_of_order FROM a GROUP BY 1""")
def out_of_order(spark, sf):
    return quality.out_of_order(b.events_telemetry(spark, sf), ["event_id"], 1000)
