"""Ingestion as a whole: files, the cleaning report, the stored history and contracts of stored facts."""

from pyspark.sql import functions as F

from checks.base import ASSETS, EVENTS, TELEMETRY_RAW, query, with_
from checks.cleaning import BOUNDS_OK, DEDUPED, MAD_SQL, REQUIRED_OK, VALID
from checks.scoring import ALL, ruled
from fieldspark.config import CleanConfig
from fieldspark.operators import anomaly, clean
from fieldspark.plans import bindings as b
from fieldspark.plans.ingest import ingest
from fieldspark.schema import ANOMALY_RULES, STANDARD
from fieldspark.session import scratch_path
from fieldspark.sources import mapping, readers, sinks

FILED = """SELECT concat('C-', CAST(o_custkey AS VARCHAR)) AS asset_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS production,
 concat(o_orderpriority, ', "x"') AS source, {kind} AS source_type FROM orders"""


def filed(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("Well Code"), F.col("o_orderdate").cast("string").alias("Reporting Date"),
        F.col("o_totalprice").alias("Oil Rate (bbl/d)"), F.concat("o_orderpriority", F.lit(', "x"')).alias("Publisher"))


def told(df):
    return df.select("asset_id", F.to_date("timestamp").alias("day"), "production", "source", "source_type")


@query("csv_source", sql=FILED.format(kind="'DERIVED'"))
def csv_source(spark, sf):
    place = scratch_path(spark, "csv")
    sinks.export_csv(filed(spark, sf), place)
    return told(mapping.to_telemetry(readers.read_csv(spark, place), source_type="derived"))


@query("public_csv", sql=FILED.format(kind="'REAL'"))
def public_csv(spark, sf):
    place = scratch_path(spark, "csv")
    sinks.export_csv(filed(spark, sf).withColumn("source_type", F.lit("SYNTHETIC")), place)
    return told(readers.load_public_csv(spark, place))


@query("json_source", sql=FILED.format(kind="'DERIVED'"))
def json_source(spark, sf):
    place = scratch_path(spark, "json")
    filed(spark, sf).write.json(place)
    return told(mapping.to_telemetry(readers.read_json(spark, place), source_type="derived"))


MISSING = ", ".join(
    f"(SELECT count(*) FILTER (WHERE NOT {test}) FROM months) AS missing_{c}" for c, test in {
        **dict.fromkeys(STANDARD, "true"), "pressure": "p", "temperature": "false", "flow_rate": "false", "valve_status": "false"}.items())


@query("clean_report", sql=with_(EVENTS) + f"""
, bent AS (SELECT CASE WHEN event_id % 13 = 0 THEN ' ' ELSE asset_id END AS asset_id, timestamp, CASE WHEN event_id % 17 <> 0 THEN production - 20 END AS production,
   source_type, CASE WHEN event_id % 101 = 0 THEN 2000 ELSE pressure END AS pressure, temperature, flow_rate, event_id FROM events_telemetry)
, req AS (SELECT * FROM bent WHERE {REQUIRED_OK})
, pos AS (SELECT * FROM req WHERE production >= 0)
, valid AS (SELECT * FROM pos WHERE {BOUNDS_OK})
, deduped AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY event_id DESC) = 1)
, filled AS (SELECT *, pressure IS NOT NULL OR (NOT bool_or(source_type = 'REAL') OVER (PARTITION BY asset_id)
   AND count(pressure) OVER (PARTITION BY asset_id) > 0) AS p_known FROM deduped)""" + MAD_SQL.format(src="filled") + f"""
, months AS (SELECT asset_id, date_trunc('month', timestamp) AS m, bool_or(p_known) AS p FROM flagged WHERE NOT is_outlier GROUP BY 1, 2)
, n AS (SELECT (SELECT count(*) FROM bent) AS bent, (SELECT count(*) FROM req) AS req, (SELECT count(*) FROM pos) AS pos, (SELECT count(*) FROM valid) AS valid,
   (SELECT count(*) FROM deduped) AS deduped, (SELECT count(*) FROM flagged WHERE is_outlier) AS outliers, (SELECT count(*) FROM months) AS months)
SELECT bent AS input_rows, bent - req AS missing_required_dropped, pos - valid AS unit_rows_dropped,
  (SELECT count(*) FROM pos WHERE production > 2000000) AS production_violations, (SELECT count(*) FROM pos WHERE pressure NOT BETWEEN 0 AND 1500) AS pressure_violations,
  0::BIGINT AS temperature_violations, 0::BIGINT AS flow_rate_violations, req - pos AS negative_dropped, 0::BIGINT AS negative_zeroed, valid - deduped AS duplicates_removed,
  (SELECT count(*) FROM filled WHERE p_known AND pressure IS NULL) AS pressure_imputed, 0::BIGINT AS temperature_imputed, 0::BIGINT AS flow_rate_imputed,
  outliers AS outliers_flagged, outliers AS outliers_removed, deduped - outliers AS monthly_input_rows, months AS monthly_output_rows, months AS output_rows, {MISSING} FROM n""")
def clean_report(spark, sf):
    bent = b.events_telemetry(spark, sf).withColumns({
        "asset_id": F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("asset_id")),
        "production": F.when(F.col("event_id") % 17 != 0, F.col("production") - 20),
        "pressure": F.when(F.col("event_id") % 101 == 0, 2000.0).otherwise(F.col("pressure"))})
    _, figures = clean.clean_counted(bent, ("event_id",), CleanConfig(impute=True, monthly=True))
    return spark.createDataFrame([tuple(figures.values())], ", ".join(f"{k} bigint" for k in figures))


@query("ingest_history", sql=with_(TELEMETRY_RAW, ASSETS, VALID, DEDUPED) + MAD_SQL.format(src="deduped") + """
, cleaned AS (SELECT * FROM flagged WHERE NOT is_outlier)
, stored AS (SELECT DISTINCT asset_id, timestamp FROM telemetry_raw WHERE l_linenumber = 1)
, fresh AS (SELECT * FROM cleaned ANTI JOIN stored USING (asset_id, timestamp))
, n AS (SELECT (SELECT count(*) FROM cleaned) AS cleaned, (SELECT count(*) FROM fresh) AS fresh, (SELECT count(*) FROM stored) AS stored)
SELECT (SELECT count(*) FROM telemetry_raw) AS rows_received, fresh AS rows_persisted, cleaned - fresh AS rows_skipped_stored,
  (SELECT count(DISTINCT asset_id) FROM cleaned WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE status = 'ACTIVE')) AS assets_created,
  (SELECT count(*) FROM flagged WHERE is_outlier) AS outliers_removed, cleaned AS output_rows, stored + fresh AS history_rows FROM n""")
def ingest_history(spark, sf):
    raw, place = b.telemetry_raw(spark, sf), scratch_path(spark, "history")
    sinks.append_new(raw.where(F.col("l_linenumber") == 1), place, order=b.LINE_ORDER)
    done = ingest(raw, place, b.assets(spark, sf).where(F.col("status") == "ACTIVE"), b.LINE_ORDER, mapped=True)
    report = done.report().select("rows_received", "rows_persisted", "rows_skipped_stored", "assets_created", "outliers_removed", "output_rows")
    return report.join(F.broadcast(spark.read.parquet(place).agg(F.count(F.lit(1)).alias("history_rows"))))  # two single rows


@query("fact_contracts", sql=ALL + """
SELECT CASE WHEN length(asset_id) % 2 = 0 THEN 'status_invalid' ELSE '' END AS reasons, count(*) AS row_count FROM state WHERE flagged_period IS NOT NULL GROUP BY 1""")
def fact_contracts(spark, sf):
    """Facts with a status that the contract doesn't know are set aside with the reason."""
    rows = sinks.anomaly_rows(anomaly.latest_window(anomaly.detect_windows(ruled(spark, sf))))
    bent = rows.withColumn("status", F.when(F.length("asset_id") % 2 == 0, "LOST").otherwise(F.col("status")))
    good, bad = scratch_path(spark, "facts"), scratch_path(spark, "rejected")
    sinks.write_facts(bent, ANOMALY_RULES, good, bad)
    both = spark.read.parquet(good).select(F.lit("").alias("reasons")).unionByName(spark.read.parquet(bad).select(F.array_join("reasons", ",").alias("reasons")))
    return both.groupBy("reasons").agg(F.count(F.lit(1)).alias("row_count"))
