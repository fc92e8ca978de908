"""Writes: idempotent appends, dimension upserts, fact rows and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.columns import clamp
from fieldspark.operators.clean import dedupe
from fieldspark.operators.quality import check_contract
from fieldspark.session import observed

# Fixed values of an asset that is registered from data alone.
PLACEHOLDER = {"field_name": "UNSPECIFIED", "basin": "UNSPECIFIED", "status": "REGISTERED"}


def _one_per_key(df: DataFrame, order: Sequence[str], keep: str, keys: Sequence[str]) -> DataFrame:
    return dedupe(df, order, keep=keep, keys=keys) if order else df.dropDuplicates(list(keys))


def new_rows(df: DataFrame, target: DataFrame, keys: Sequence[str] = ("asset_id", "timestamp"),
             order: Sequence[str] = (), keep: str = "first", prune: tuple | None = None, unique: bool = False) -> DataFrame:
    """Rows of the batch that are not stored yet; one row per key.

    The anti-join sees only the key columns of the target. `prune` (first, last) limits the target to the batch's time
    range before the join, so a partitioned target is not scanned whole. A batch that is `unique` holds no key twice and
    is not grouped again.
    """
    batch = df if unique else _one_per_key(df, order, keep, keys)
    stored = target.select(*keys)
    if prune is not None:
        stored = stored.where(F.col(keys[-1]).between(F.lit(prune[0]), F.lit(prune[1])))
    return batch.join(stored, list(keys), "left_anti")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at the path, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: Sequence[str] = ("asset_id", "timestamp"), order: Sequence[str] = (),
               prune: bool = True, unique: bool = False) -> int:
    """Idempotent append to a Parquet table partitioned by year and month; the number of rows written.

    The anti-join reads the stored keys of just the months that the batch holds, however far they lie apart. `unique` tells
    that the batch holds no key twice, which spares grouping its rows.
    """
    spark = df.sparkSession
    stamped = df.withColumns({"year": F.year(keys[-1]), "month": F.month(keys[-1])})
    target = read_table(spark, path)
    if target is None:
        fresh = stamped if unique else _one_per_key(stamped, order, "first", keys)
    else:
        if prune:
            at = F.col("year") * 12 + F.col("month")
            months = [r["m"] for r in stamped.select(at.alias("m")).distinct().collect() if r["m"] is not None]  # bounded by the calendar
            target = target.where(at.isin(months))
        fresh = new_rows(stamped, target, keys, order, unique=unique)
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("rows")).repartition(
        "year", "month", F.pmod(F.xxhash64(keys[0]), F.lit(16))).sortWithinPartitions(*keys).write.mode(
        "append").partitionBy("year", "month").parquet(path)
    return (observed(seen, None, ()) or {"rows": 0})["rows"]  # lost only where there was nothing to write


def write_facts(rows: DataFrame, rules: Mapping[str, str], path: str, rejected: str, mode: str = "append") -> dict[str, int]:
    """Stores the fact rows that satisfy every rule of the contract, and the others with their `reasons` beside them.

    The counts of both, as `stored` and `rejected`.
    """
    good, bad = check_contract(rows, rules)
    counts = {}
    for what, part, place in (("stored", good, path), ("rejected", bad, rejected)):
        seen, rows_of = Observation(), F.count(F.lit(1)).alias("rows")
        part.observe(seen, rows_of).write.mode(mode).parquet(place)
        counts[what] = observed(seen, part, [rows_of])["rows"]
    return counts


def register_assets(df: DataFrame, assets: DataFrame) -> DataFrame:
    """Placeholder rows for assets of the data that the dimension lacks."""
    unknown = df.select("asset_id").distinct().join(assets.select("asset_id"), "asset_id", "left_anti")
    return unknown.withColumns({c: F.lit(v) for c, v in PLACEHOLDER.items()})


def drop_unknown_assets(df: DataFrame, assets: DataFrame) -> DataFrame:
    return df.join(assets.select("asset_id").distinct(), "asset_id", "left_semi")


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], updated: str) -> DataFrame:
    """Union of both tables with the most recently updated row per key."""
    cols = [c for c in stored.columns if c not in keys]
    rest = F.struct(F.col(updated).alias("_u"), *[F.col(c) for c in cols if c != updated])
    picked = stored.unionByName(incoming).groupBy(*keys).agg(F.max(rest).alias("_r"))
    return picked.select(*keys, *[F.col("_r._u").alias(c) if c == updated else F.col(f"_r.{c}") for c in cols])


def upsert_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A known (source, dataset) keeps its row and only gets the newer touch time; an unknown one is inserted."""
    keys = ["source_name", "dataset_name"]
    rest = [c for c in stored.columns if c not in (*keys, "last_updated")]
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    kept = both.groupBy(*keys).agg(
        F.min(F.struct("_new", *rest)).alias("_r"), F.max("last_updated").alias("last_updated"))
    return kept.select(*keys, *[F.col(f"_r.{c}") for c in rest], "last_updated")


def ingest_report(received: DataFrame, cleaned: DataFrame, persisted: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: received, surviving, persisted, skipped as stored, and newly registered assets."""
    parts = [
        received.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("received")),
        cleaned.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("cleaned")),
        persisted.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("persisted")),
        register_assets(cleaned, assets).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("assets")),
    ]
    all_counts = parts[0]
    for p in parts[1:]:
        all_counts = all_counts.unionByName(p)

    def pick(what: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("what") == what, F.col("n"))), F.lit(0))

    return all_counts.agg(
        pick("received").alias("rows_received"), pick("cleaned").alias("rows_clean"),
        pick("persisted").alias("rows_persisted"), (pick("cleaned") - pick("persisted")).alias("rows_skipped"),
        pick("assets").alias("assets_created"))


def force_provenance(df: DataFrame, source_type: str = "SYNTHETIC") -> DataFrame:
    return df.withColumn("source_type", F.lit(source_type))


def forecast_rows(points: DataFrame, last_period: str = "last_period", sigma: str = "residual_std",
                  model: str = "gbt", version: str = "v1") -> DataFrame:
    """Forecast facts: target month and a confidence clipped to 0.3..0.95."""
    share = F.lit(1.0) - F.col(sigma) / F.greatest(F.col("forecast"), F.lit(1e-9))
    return points.select(
        "asset_id", F.col("step").cast("int").alias("step"), F.col("forecast").alias("forecast_value"),
        F.add_months(F.trunc(last_period, "month"), F.col("step").cast("int")).alias("forecast_date"),
        clamp(share, 0.3, 0.95).alias("confidence"), F.lit(model).alias("model_type"), F.lit(version).alias("model_version"))


def anomaly_rows(latest: DataFrame) -> DataFrame:
    return latest.select(
        "asset_id", F.col("period").alias("event_date"), "anomaly_score", "severity",
        F.col("deviation_pct").alias("production_deviation"), F.lit("UNACKNOWLEDGED").alias("status"))


def score_rows(scored: DataFrame) -> DataFrame:
    return scored.select(
        "asset_id", "score", "priority", F.col("loss_pct").alias("loss_magnitude"),
        (F.col("anomaly_score") * 100.0).alias("anomaly_severity"), F.col("recovery_pct").alias("recovery_opportunity"),
        F.col("combined_confidence").alias("recovery_confidence"),
        (F.col("complexity") * 100.0).alias("intervention_complexity"))


def metric_rows(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metrics -> one row per (ids, metric)."""
    return wide.unpivot(list(ids), list(metrics), "metric_name", "metric_value")


def export_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)
