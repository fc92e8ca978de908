"""Bind a star schema of order lines and user events to the telemetry, monthly and asset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.operators.clean import monthly_panel

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # stored timestamps carry no zone; they are UTC by convention of the data
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _asset(key: str):
    return F.concat(F.lit("A-"), F.col(key).cast("string"))


def telemetry_raw(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    return line.select(
        _asset("l_suppkey").alias("asset_id"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_quantity").alias("production"),
        F.when(F.col("l_linenumber") != 1, F.concat(F.lit("src-"), F.col("l_linestatus"))).alias("source"),
        F.when(F.col("l_returnflag") == "R", "REAL").when(F.col("l_returnflag") == "A", "SYNTHETIC")
        .otherwise("DERIVED").alias("source_type"),
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice") / 65).alias("pressure"),
        (F.nullif(F.col("l_discount"), F.lit(0.0)) * 1000).alias("temperature"),
        (F.col("l_quantity") * (F.lit(1) + F.col("l_tax"))).alias("flow_rate"),
        F.when(F.col("l_linenumber") % 5 != 0, F.when(F.col("l_linestatus") == "F", "CLOSED").otherwise("OPEN"))
        .alias("valve_status"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def events_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    kind = F.col("user_id") % 3
    return ev.select(
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("asset_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("production"),
        F.col("event_type").alias("source"),
        F.when(kind == 0, "REAL").when(kind == 1, "SYNTHETIC").otherwise("DERIVED").alias("source_type"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") * 2).alias("pressure"),
        F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("double").alias("flow_rate"),
        F.lit(None).cast("string").alias("valve_status"), "props", "event_id")


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """MONTHLY with the mean of the six months before as expectation (NULL in the first month)."""
    line = table(spark, folder, "lineitem").select(
        _asset("l_suppkey").alias("asset_id"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("production"))
    panel = monthly_panel(line, how="sum")
    before = Window.partitionBy("asset_id").orderBy("t").rowsBetween(-6, -1)
    return panel.withColumn("expected", F.avg("actual").over(before))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    sup, nat, reg = (table(spark, folder, n) for n in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    return (
        sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _asset("s_suppkey").alias("asset_id"), F.col("n_name").alias("field_name"), F.col("r_name").alias("basin"),
            F.when(key % 12 == 10, "DORMANT").otherwise("ACTIVE").alias("status"),
            (F.lit(1985) + key % 30).cast("int").alias("onstream_year"),
            (F.lit(0.5) + (key % 14) / F.lit(10.0)).cast("double").alias("intervention_cost"),
            (F.lit(250) + key % 50).cast("double").alias("qi"),
            (F.lit(0.001) + (key % 5) / F.lit(1000.0)).cast("double").alias("di"),
            (F.lit(0.45) + (key % 30) / F.lit(100.0)).cast("double").alias("b")))
