"""Canonical schemas and the contract rules of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from fieldspark.config import (
    ANOMALY_STATUSES, PRIORITIES, SEVERITIES, SOURCE_TYPES, VALVE_STATES,
)

REQUIRED = ("asset_id", "timestamp", "production", "source", "source_type")
MEASURES = ("pressure", "temperature", "flow_rate")
OPTIONAL = (*MEASURES, "valve_status")
STANDARD = (*REQUIRED, *OPTIONAL)

TELEMETRY = T.StructType([
    T.StructField("asset_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("production", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("flow_rate", T.DoubleType()),
    T.StructField("valve_status", T.StringType()),
])

MONTHLY = T.StructType([
    T.StructField("asset_id", T.StringType()),
    T.StructField("period", T.DateType()),
    T.StructField("t", T.IntegerType()),
    T.StructField("actual", T.DoubleType()),
    T.StructField("expected", T.DoubleType()),
])


def _one_of(col: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"{col} IS NULL OR {col} IN ({listed})"


# rule name -> SQL predicate that must not be false
TELEMETRY_RULES = {
    "asset_id_missing": "asset_id IS NOT NULL AND length(trim(asset_id)) > 0",
    "asset_id_too_long": "asset_id IS NULL OR length(asset_id) <= 32",
    "timestamp_missing": "timestamp IS NOT NULL",
    "production_missing": "production IS NOT NULL",
    "source_type_invalid": f"source_type IS NOT NULL AND ({_one_of('source_type', SOURCE_TYPES)})",
    "valve_status_invalid": _one_of("valve_status", VALVE_STATES),
}
SCORE_RULES = {
    "score_out_of_range": "score IS NULL OR score BETWEEN 0 AND 100",
    "priority_invalid": _one_of("priority", PRIORITIES),
}
ANOMALY_RULES = {
    "score_out_of_range": "anomaly_score IS NULL OR anomaly_score BETWEEN 0 AND 1",
    "severity_invalid": _one_of("severity", SEVERITIES),
    "status_invalid": _one_of("status", ANOMALY_STATUSES),
}
ASSET_RULES = {
    "asset_id_invalid": "asset_id IS NOT NULL AND length(asset_id) BETWEEN 1 AND 32",
    "latitude_out_of_range": "latitude IS NULL OR latitude BETWEEN -90 AND 90",
    "longitude_out_of_range": "longitude IS NULL OR longitude BETWEEN -180 AND 180",
    "rate_out_of_range": "qi IS NULL OR qi BETWEEN 0 AND 1000000",
    "decline_out_of_range": "di IS NULL OR di BETWEEN 0 AND 1",
    "exponent_out_of_range": "b IS NULL OR b BETWEEN 0 AND 2",
}
DATE_ORDER_RULE = {"date_order": "start_date IS NULL OR end_date IS NULL OR start_date <= end_date"}
