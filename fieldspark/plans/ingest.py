"""One call from a raw table to the stored history: map, clean, register assets, append, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.config import CleanConfig
from fieldspark.operators import clean
from fieldspark.sources import mapping, sinks


class IngestError(ValueError):
    """Nothing to ingest."""


@dataclass(frozen=True)
class Ingested:
    """What an ingest did: its figures, the texts-free `issues` codes with their counts, and the rows for the dimension tables."""

    figures: dict[str, int]
    issues: dict[str, int]
    assets: DataFrame
    source: DataFrame

    def report(self) -> DataFrame:
        """One row: every figure, and the issues as a map."""
        spark = self.assets.sparkSession
        fields = [T.StructField(k, T.LongType()) for k in self.figures]
        schema = T.StructType([*fields, T.StructField("issues", T.MapType(T.StringType(), T.LongType()))])
        return spark.createDataFrame([(*self.figures.values(), self.issues)], schema)


def ingest(df: DataFrame, history: str, assets: DataFrame, order: Sequence[str], config: CleanConfig = CleanConfig(), *,
           dataset: str = "dataset", column_map: Mapping[str, str] | None = None, source_type: str | None = None,
           create_assets: bool = True, mapped: bool = False) -> Ingested:
    """Map and clean the rows, append the new ones to the history table at the path, and report.

    `order` is a total order of the rows of one key, in columns of the input that the mapping keeps or, with `mapped`, any
    of an input that is telemetry already. A key that the history holds is skipped. Rows of assets that the dimension lacks are stored, and placeholders for those
    assets are returned in `assets`; without `create_assets` such rows are skipped instead. An input without rows is an error; an input of which no row
    survives the cleaning is not, and stores nothing. A second call with the same rows stores nothing.
    """
    if df.isEmpty():
        raise IngestError("no rows to ingest")
    telemetry = df if mapped else mapping.to_telemetry(df, column_map, source_type)
    rows, figures = clean.clean_counted(telemetry, order, config)
    issues = {"unit_violations": figures["unit_rows_dropped"], "outliers_removed": figures["outliers_removed"]}
    unknown = sinks.register_assets(rows, assets)
    created = 0
    if create_assets:
        created = unknown.count()
    else:
        known = sinks.drop_unknown_assets(rows, assets)
        kept = known.count()
        issues["unknown_assets_skipped"] = figures["output_rows"] - kept
        rows, unknown = known, unknown.limit(0)
    offered = figures["output_rows"] - issues.get("unknown_assets_skipped", 0)
    once = config.monthly or config.copies is not None  # the cleaning left one row per key
    stored = sinks.append_new(rows, history, order=[c for c in order if c in rows.columns], unique=once) if offered else 0
    if not figures["output_rows"]:
        issues["nothing_left"] = figures["input_rows"]
    figures = {"rows_received": figures["input_rows"], "rows_persisted": stored, "rows_skipped_stored": offered - stored, "assets_created": created, **figures}
    kind = F.coalesce(F.max("source_type"), F.lit(source_type))
    source = rows.agg(kind.alias("source_type"), F.count(F.lit(1)).alias("_n")).where("_n > 0").select(
        F.lit("EXTERNAL").alias("source_name"), F.lit(dataset).alias("dataset_name"), "source_type", F.current_timestamp().alias("last_updated"))
    return Ingested(figures, {k: n for k, n in issues.items() if n}, unknown, source)


def ingest_synthetic(df: DataFrame, history: str, assets: DataFrame, order: Sequence[str], config: CleanConfig = CleanConfig(), **options) -> Ingested:
    """The same for generated readings: whatever they say, their provenance is SYNTHETIC."""
    return ingest(sinks.force_provenance(df), history, assets, order, config, **{"dataset": "generated", **options})
