"""Streaming queries and their batch twins, and the sinks, on the event and order-line telemetry."""

from pyspark.sql import functions as F

from checks.base import ASSETS, EVENTS, TELEMETRY_RAW, query, rounded, with_
from checks.scoring import SEV
from fieldspark.operators import clean
from fieldspark.plans import bindings as b
from fieldspark.session import scratch_path
from fieldspark.sources import sinks
from fieldspark.streaming import ordered
from fieldspark.streaming import telemetry as st

TICKS = """
, tk AS (SELECT asset_id, timestamp, production AS actual, avg(production) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS expected FROM events_telemetry)
, fe AS (SELECT *, (actual - expected) / greatest(expected, 1e-9) AS dev, coalesce((actual - lag(actual) OVER w) / nullif(lag(actual) OVER w, 0), 0) AS change_rate,
   avg(actual) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean,
   coalesce(stddev_samp(actual) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS rolling_std,
   count(*) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS seen
  FROM tk WHERE expected IS NOT NULL WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp))
, t1 AS (SELECT *, least(abs(change_rate), 1) * 0.9::DOUBLE AS raw, least(abs(dev) * 5, 1) AS rule FROM fe)
, t2 AS (SELECT *, CASE WHEN seen >= 6 THEN CASE WHEN rule >= 0.5 THEN greatest(raw, rule) ELSE raw END ELSE 0 END AS anomaly_score FROM t1)
, t3 AS (SELECT *, CASE WHEN anomaly_score > 0.85::DOUBLE THEN 0.9::DOUBLE WHEN anomaly_score >= 0.7::DOUBLE THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS conf, greatest(expected, 1e-9) AS ex FROM t2)
, t4 AS (SELECT *, least(greatest((0.3::DOUBLE * abs(ex - actual) / ex * 100 + 0.25::DOUBLE * anomaly_score * 100 + 0.35::DOUBLE * greatest(ex - actual, 0) / ex * 100 * 0.8::DOUBLE * conf - 0.1::DOUBLE * 0.5 * 100) / 30 * 100, 0), 100) AS score FROM t3)
, ticks AS (SELECT *, """ + SEV.format(s="anomaly_score") + """ AS severity, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS priority, dev * 100 AS deviation_pct FROM t4)"""


def readings(spark, sf):
    """Events as ticks; the expectation is the mean of the six readings before."""
    ev = b.events_telemetry(spark, sf).select("asset_id", "timestamp", F.col("production").alias("actual"))
    return st.over_slices(ev, ["asset_id"], ["timestamp"], lambda w: {"expected": F.avg("actual").over(w.rowsBetween(-6, -1))}, 6, "timestamp", "day")


def to_ticks(rows, slice_unit="day"):
    feats = st.tick_features(rows, slice_unit)
    raw = F.least(F.abs("change_rate"), F.lit(1.0)) * 0.9
    out = st.score_ticks(feats.withColumns({"raw_score": raw, "complexity": F.lit(0.5)}))
    return out.withColumn("deviation_pct", F.col("dev_fraction") * 100.0)


def _micros(df):
    return df.withColumn("at", F.unix_micros("timestamp")).drop("timestamp")


TICK_SQL = with_(EVENTS) + TICKS + """
SELECT asset_id, epoch_us(timestamp) AS at, severity, priority, round(anomaly_score, 6) AS anomaly_score, round(score, 5) AS score FROM ticks"""


@query("score_ticks", sql=TICK_SQL)
def score_ticks(spark, sf):
    out = _micros(to_ticks(readings(spark, sf)))
    return out.select("asset_id", "at", "severity", "priority", F.round("anomaly_score", 6).alias("anomaly_score"), F.round("score", 5).alias("score"))


@query("stream_scored", sql=TICK_SQL)
def stream_scored(spark, sf):
    """The events file as a stream through the buffer sink, read back."""
    source = b.table(spark, sf, "events")
    stream = st.telemetry_stream(spark, f"{sf}/events*.parquet", source.schema, time_col="ts")
    ticks = st.dedupe_stream(st.with_lateness(stream.select(
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("asset_id"), F.col("ts").alias("timestamp"), F.col("value").alias("actual"))))

    def transform(both):
        held = st.over_slices(both, ["asset_id"], ["timestamp"], lambda w: {"expected": F.avg("actual").over(w.rowsBetween(-6, -1))}, 6, "timestamp", "day")
        return to_ticks(held)

    place = scratch_path(spark, "stream-scored")
    run = st.write_observations(ticks, f"{place}/table", f"{place}/checkpoint", transform)
    run.awaitTermination()
    out = _micros(st.read_observations(spark, f"{place}/table"))
    return out.select("asset_id", "at", "severity", "priority", F.round("anomaly_score", 6).alias("anomaly_score"), F.round("score", 5).alias("score"))


# Rows that the watermark has passed; it is a whole millisecond an hour behind the newest reading.
PASSED = TICKS + """
, passed AS (SELECT * FROM ticks WHERE epoch_us(timestamp) <= 1000 * ((SELECT epoch_ms(max(timestamp)) FROM events_telemetry) - 3600000))"""


def state_scored(spark, sf, place):
    """The events file as a stream whose assets keep their last readings in state; scores go to a folder."""
    source = b.table(spark, sf, "events")
    stream = st.telemetry_stream(spark, f"{sf}/events*.parquet", source.schema, time_col="ts")
    rows = st.with_lateness(stream.select(
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("asset_id"), F.col("ts").alias("timestamp"), F.col("value").alias("actual")), "1 hour")
    feats = ordered.features_from_past(ordered.expected_from_past(ordered.with_past(rows, ["actual"], 16)))
    raw = F.least(F.abs("change_rate"), F.lit(1.0)) * 0.9
    out = st.score_ticks(feats.withColumns({"raw_score": raw, "complexity": F.lit(0.5)})).withColumn("deviation_pct", F.col("dev_fraction") * 100.0)
    out = out.select("asset_id", "timestamp", "severity", "priority", "deviation_pct", "anomaly_score", "score")
    ordered.append_stream(out, f"{place}/scored", f"{place}/checkpoint").awaitTermination()
    return out.schema


@query("stream_state_scored", sql=with_(EVENTS) + PASSED + """
SELECT asset_id, epoch_us(timestamp) AS at, severity, priority, round(anomaly_score, 6) AS anomaly_score, round(score, 5) AS score FROM passed""")
def stream_state_scored(spark, sf):
    place = scratch_path(spark, "stream-state")
    state_scored(spark, sf, place)
    out = _micros(spark.read.parquet(f"{place}/scored"))
    return out.select("asset_id", "at", "severity", "priority", F.round("anomaly_score", 6).alias("anomaly_score"), F.round("score", 5).alias("score"))


@query("stream_transitions", sql=with_(EVENTS) + PASSED + """
, l AS (SELECT *, coalesce(lag(severity) OVER w, 'NORMAL') AS ps, coalesce(lag(priority) OVER w, 'LOW') AS pp FROM passed WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp))
, e AS (SELECT asset_id, timestamp, 'ANOMALY' AS category, severity AS label, severity AS level FROM l WHERE severity <> ps
UNION ALL SELECT asset_id, timestamp, 'DEVIATION', 'BELOW_EXPECTATION', 'WATCH' FROM l WHERE severity = ps AND severity = 'NORMAL' AND deviation_pct < -10
UNION ALL SELECT asset_id, timestamp, 'PRIORITY', priority, severity FROM l WHERE priority <> pp)
SELECT asset_id, epoch_us(timestamp) AS at, category, label, level FROM e WHERE epoch_us(timestamp) <= 1000 * (SELECT epoch_ms(max(timestamp)) FROM passed)""")
def stream_transitions(spark, sf):
    """Severity and priority of each asset's last reading as state, behind the scores; the scores of a batch are read together."""
    place = scratch_path(spark, "stream-transitions")
    events = ordered.transition_stream(spark, f"{place}/scored", state_scored(spark, sf, place), "0 seconds")
    ordered.append_stream(events, f"{place}/events", f"{place}/checkpoint-events").awaitTermination()
    return _micros(spark.read.parquet(f"{place}/events"))


@query("stream_set_aside", sql=with_(EVENTS) + """
, parts AS (SELECT DISTINCT asset_id, timestamp, event_id % 3 AS part FROM events_telemetry)
SELECT 'stored' AS status, count(DISTINCT (asset_id, timestamp)) AS row_count FROM parts WHERE part <> 1
UNION ALL SELECT 'set_aside', count(*) FROM parts WHERE part = 1""")
def stream_set_aside(spark, sf):
    """Three batches, of which the second can't be transformed: it is set aside whole, the others are stored and then merged."""
    rows = b.events_telemetry(spark, sf).select("asset_id", "timestamp", "production", "event_id")
    place = scratch_path(spark, "stream-set-aside")
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{place}/in")
    source = st.telemetry_stream(spark, f"{place}/in", rows.schema, maxFilesPerTrigger="1")

    def refuse(df):
        bad = F.col("_new") & (F.col("event_id") % 3 == 1)
        return df.withColumn("production", F.when(bad, F.raise_error(F.lit("part 1")).cast("double")).otherwise(F.col("production")))

    st.write_observations(source, f"{place}/table", f"{place}/checkpoint", refuse, on_error="set_aside").awaitTermination()
    st.compact_observations(spark, f"{place}/table")
    keys = ["asset_id", "timestamp"]
    kept = st.read_observations(spark, f"{place}/table").select(*keys).unionByName(st.late_observations(spark, f"{place}/table").select(*keys))
    both = kept.withColumn("status", F.lit("stored")).unionByName(st.aside_observations(spark, f"{place}/table").select(*keys, F.lit("set_aside").alias("status")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))


@query("stream_window", sql="""
WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT event_type AS source, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS readings, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi
FROM events, m GROUP BY 1, 2, mark HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= mark""")
def stream_window(spark, sf):
    """Daily windows in append mode: only days that the watermark has closed are emitted."""
    source = b.table(spark, sf, "events")
    stream = st.telemetry_stream(spark, f"{sf}/events*.parquet", source.schema, time_col="ts")
    rows = stream.select(F.col("event_type").alias("source"), F.col("ts").alias("timestamp"), F.col("value").alias("production"))
    agg = st.window_agg(st.with_lateness(rows, "1 hour"), "1 day", by=("source",))
    place = scratch_path(spark, "stream-window")
    agg.writeStream.format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{place}/table").select("source", F.to_date("start").alias("day"), "readings", "mean", "lo", "hi"))


@query("window_sliding", sql=with_(EVENTS) + """
, w AS (SELECT asset_id, production, unnest([date_trunc('day', timestamp), date_trunc('day', timestamp) - INTERVAL 1 DAY]) AS s FROM events_telemetry)
SELECT asset_id, CAST(s AS DATE) AS start_day, count(*) AS readings, round(avg(production), 6) AS mean FROM w GROUP BY 1, 2""")
def window_sliding(spark, sf):
    out = st.window_agg(b.events_telemetry(spark, sf), "2 days", "1 day")
    return rounded(out.select("asset_id", F.to_date("start").alias("start_day"), "readings", "mean"))


@query("window_session", sql=with_(EVENTS) + """
, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w >= INTERVAL 6 HOUR OR lag(timestamp) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events_telemetry WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp))
, s AS (SELECT *, sum(n) OVER (PARTITION BY asset_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT asset_id, epoch_us(min(timestamp)) AS start_at, count(*) AS readings, round(avg(production), 6) AS mean FROM s GROUP BY asset_id, sid""")
def window_session(spark, sf):
    out = st.session_agg(b.events_telemetry(spark, sf), "6 hours")
    return rounded(out.select("asset_id", F.unix_micros("start").alias("start_at"), "readings", "mean"))


@query("transitions", sql=with_(EVENTS) + TICKS + """
, l AS (SELECT *, coalesce(lag(severity) OVER w, 'NORMAL') AS ps, coalesce(lag(priority) OVER w, 'LOW') AS pp FROM ticks WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp))
SELECT asset_id, epoch_us(timestamp) AS at, 'ANOMALY' AS category, severity AS label, severity AS level FROM l WHERE severity <> ps
UNION ALL SELECT asset_id, epoch_us(timestamp), 'DEVIATION', 'BELOW_EXPECTATION', 'WATCH' FROM l WHERE severity = ps AND severity = 'NORMAL' AND deviation_pct < -10
UNION ALL SELECT asset_id, epoch_us(timestamp), 'PRIORITY', priority, severity FROM l WHERE priority <> pp""")
def transitions(spark, sf):
    return _micros(st.transitions(to_ticks(readings(spark, sf))))


@query("onsets", sql=with_(EVENTS) + TICKS + """
, l AS (SELECT *, coalesce(lag(severity) OVER (PARTITION BY asset_id ORDER BY timestamp), 'NORMAL') AS ps FROM ticks)
SELECT asset_id, epoch_us(timestamp) AS at, severity FROM l WHERE ps = 'NORMAL' AND severity <> 'NORMAL'""")
def onsets(spark, sf):
    return _micros(st.onsets(to_ticks(readings(spark, sf)))).select("asset_id", "at", "severity")


@query("latest_n", sql=with_(EVENTS) + """
SELECT asset_id, event_id FROM events_telemetry QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC) <= 50""")
def latest_n(spark, sf):
    return st.latest_n(b.events_telemetry(spark, sf), 50).select("asset_id", "event_id")


@query("stream_summary", sql=with_(EVENTS) + TICKS + """
, c AS (SELECT asset_id, count(*) AS ticks FROM ticks GROUP BY 1)
SELECT t.asset_id, c.ticks, epoch_us(timestamp) AS last_at, severity, priority, round(score, 5) AS score FROM ticks t JOIN c USING (asset_id)
QUALIFY row_number() OVER (PARTITION BY t.asset_id ORDER BY timestamp DESC) = 1""")
def stream_summary(spark, sf):
    out = st.stream_summary(to_ticks(readings(spark, sf)))
    return out.select("asset_id", "ticks", F.unix_micros("last_timestamp").alias("last_at"), "severity", "priority", F.round("score", 5).alias("score"))


@query("attach_forecast", sql=with_(EVENTS) + """
, t AS (SELECT asset_id, event_id, CAST(replace(asset_id, 'U-', '') AS BIGINT) AS k FROM events_telemetry)
SELECT asset_id, event_id, CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS forecast_30d FROM t""")
def attach_forecast(spark, sf):
    ticks = b.events_telemetry(spark, sf).select("asset_id", "event_id")
    k = F.regexp_replace("asset_id", "U-", "").cast("bigint")
    pts = ticks.select("asset_id").distinct().where(k % 2 == 0).select("asset_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"))
    return st.attach_forecast(ticks, pts.withColumn("forecast", k * F.col("step").cast("double")))


# --------------------------------------------------------------------------------------------------------------- sinks
@query("append_new", sql=with_(TELEMETRY_RAW) + """
, stored AS (SELECT DISTINCT asset_id, timestamp FROM telemetry_raw WHERE l_linenumber <= 2)
, one AS (SELECT * FROM telemetry_raw QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1)
SELECT asset_id, CAST(timestamp AS DATE) AS day, production, l_orderkey, l_linenumber FROM one ANTI JOIN stored USING (asset_id, timestamp)""")
def append_new(spark, sf):
    rows = b.telemetry_raw(spark, sf)
    out = sinks.new_rows(rows, rows.where(F.col("l_linenumber") <= 2), order=b.LINE_ORDER)
    return out.select("asset_id", F.to_date("timestamp").alias("day"), "production", "l_orderkey", "l_linenumber")


@query("append_table", sql=with_(TELEMETRY_RAW) + """
SELECT CAST(year(timestamp) AS INTEGER) AS year, count(DISTINCT (asset_id, timestamp)) AS row_count FROM telemetry_raw GROUP BY 1""")
def append_table(spark, sf):
    """The table after two overlapping appends: each key once."""
    rows = b.telemetry_raw(spark, sf)
    place = scratch_path(spark, "append-table")
    sinks.append_new(rows.where(F.col("l_linenumber") <= 4), place, order=b.LINE_ORDER)
    sinks.append_new(rows, place, order=b.LINE_ORDER)
    return spark.read.parquet(place).groupBy("year").agg(F.count(F.lit(1)).alias("row_count"))


@query("register_assets", sql=with_(TELEMETRY_RAW, ASSETS) + """
SELECT DISTINCT asset_id, 'UNSPECIFIED' AS field_name, 'UNSPECIFIED' AS basin, 'REGISTERED' AS status FROM telemetry_raw
WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE status = 'ACTIVE')""")
def register_assets(spark, sf):
    return sinks.register_assets(b.telemetry_raw(spark, sf), b.assets(spark, sf).where(F.col("status") == "ACTIVE"))


@query("drop_unknown_assets", sql=with_(TELEMETRY_RAW, ASSETS) + """
SELECT asset_id, count(*) AS row_count FROM telemetry_raw WHERE asset_id IN (SELECT asset_id FROM assets WHERE status = 'ACTIVE') GROUP BY 1""")
def drop_unknown_assets(spark, sf):
    out = sinks.drop_unknown_assets(b.telemetry_raw(spark, sf), b.assets(spark, sf).where(F.col("status") == "ACTIVE"))
    return out.groupBy("asset_id").agg(F.count(F.lit(1)).alias("row_count"))


SRC = """src AS (SELECT o_orderpriority AS source_name, concat('D-', CAST(o_custkey AS VARCHAR)) AS dataset_name, o_orderstatus AS source_type, o_orderkey AS k, o_orderdate AS last_updated FROM orders)"""


def source_rows(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("source_name"), F.concat(F.lit("D-"), F.col("o_custkey").cast("string")).alias("dataset_name"),
        F.col("o_orderstatus").alias("source_type"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("last_updated"))


@query("upsert_sources", sql=with_(SRC) + """
, stored AS (SELECT source_name, dataset_name, min_by(source_type, k) AS source_type, max(last_updated) AS last_updated FROM src WHERE k % 2 = 0 GROUP BY 1, 2)
, incoming AS (SELECT source_name, dataset_name, min_by(source_type, k) AS source_type, max(last_updated) AS last_updated FROM src WHERE k % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(s.source_name, i.source_name) AS source_name, coalesce(s.dataset_name, i.dataset_name) AS dataset_name, coalesce(s.source_type, i.source_type) AS source_type,
 CAST(greatest(s.last_updated, i.last_updated) AS DATE) AS last_day FROM stored s FULL JOIN incoming i ON s.source_name = i.source_name AND s.dataset_name = i.dataset_name""")
def upsert_sources(spark, sf):
    rows = source_rows(spark, sf)

    def half(r: int):
        return rows.where(F.col("k") % 2 == r).groupBy("source_name", "dataset_name").agg(
            F.min_by("source_type", "k").alias("source_type"), F.max("last_updated").alias("last_updated"))

    out = sinks.upsert_sources(half(0), half(1))
    return out.withColumn("last_day", F.to_date("last_updated")).drop("last_updated")


@query("upsert_latest", sql=with_(SRC) + """
SELECT source_name, dataset_name, k FROM src QUALIFY row_number() OVER (PARTITION BY source_name, dataset_name ORDER BY last_updated DESC, k DESC) = 1""")
def upsert_latest(spark, sf):
    rows = source_rows(spark, sf).select("source_name", "dataset_name", "k", "last_updated")
    out = sinks.upsert_latest(rows.where(F.col("k") % 2 == 0), rows.where(F.col("k") % 2 == 1), ["source_name", "dataset_name"], "last_updated")
    return out.select("source_name", "dataset_name", "k")


@query("ingest_report", sql=with_(TELEMETRY_RAW, ASSETS) + """
, v AS (SELECT DISTINCT asset_id, timestamp FROM telemetry_raw WHERE coalesce(pressure BETWEEN 0 AND 1500, true))
, p AS (SELECT * FROM v ANTI JOIN (SELECT asset_id, timestamp FROM telemetry_raw WHERE l_linenumber = 1) s USING (asset_id, timestamp))
SELECT (SELECT count(*) FROM telemetry_raw) AS rows_received, (SELECT count(*) FROM v) AS rows_clean, (SELECT count(*) FROM p) AS rows_persisted,
 (SELECT count(*) FROM v) - (SELECT count(*) FROM p) AS rows_skipped, (SELECT count(DISTINCT asset_id) FROM v WHERE asset_id NOT IN (SELECT asset_id FROM assets WHERE status = 'ACTIVE')) AS assets_created""")
def ingest_report(spark, sf):
    raw = b.telemetry_raw(spark, sf)
    cleaned = clean.dedupe(clean.validate_units(raw), b.LINE_ORDER)
    fresh = sinks.new_rows(cleaned, raw.where(F.col("l_linenumber") == 1), order=b.LINE_ORDER)
    return sinks.ingest_report(raw, cleaned, fresh, b.assets(spark, sf).where(F.col("status") == "ACTIVE"))


@query("force_provenance", sql=with_(TELEMETRY_RAW) + " SELECT 'SYNTHETIC' AS source_type, count(*) AS row_count FROM telemetry_raw")
def force_provenance(spark, sf):
    return sinks.force_provenance(b.telemetry_raw(spark, sf)).groupBy("source_type").agg(F.count(F.lit(1)).alias("row_count"))
