"""Quality reports, provenance and contract checks. All are mergeable aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.sliced import over_slices
from fieldspark.schema import STANDARD


def missingness(df: DataFrame, columns: Sequence[str] = STANDARD) -> DataFrame:
    """Column -> number of NULLs; an absent column counts every row."""
    counts = df.agg(*[
        (F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "missing")


def duplicate_count(df: DataFrame, keys: Sequence[str] = ("asset_id", "timestamp")) -> DataFrame:
    """Rows beyond the first per key."""
    extra = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    return extra.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))


def distribution(df: DataFrame, col: str, none: str = "(none)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col), F.lit(none)).alias("label")).agg(F.count(F.lit(1)).alias("row_count"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row per asset-and-timestamp key first, so the distinct, duplicate and total counts share one shuffle."""
    nulls = [c for c in STANDARD if c in df.columns]
    per_key = df.groupBy("asset_id", "timestamp").agg(
        F.count(F.lit(1)).alias("c"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in nulls])
    per_asset = per_key.groupBy("asset_id").agg(
        F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("dups"), F.min("timestamp").alias("a"),
        F.max("timestamp").alias("b"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in nulls])
    return per_asset.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("number_of_rows"),
        F.count("asset_id").alias("assets"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"),
        F.coalesce(F.sum("dups"), F.lit(0)).cast("bigint").alias("duplicate_count"),
        *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).cast("bigint").alias(f"missing_{c}") for c in nulls])


def distributions(df: DataFrame) -> DataFrame:
    """Source and provenance distributions in one long table, from one grouping-sets pass."""
    src = F.coalesce(F.col("source"), F.lit("(none)"))
    kind = F.coalesce(F.col("source_type"), F.lit("(none)"))
    pairs = df.groupBy(src.alias("s"), kind.alias("k")).agg(F.count(F.lit(1)).alias("c"))
    long = pairs.select("c", F.explode(F.array(
        F.struct(F.lit("source").alias("dimension"), F.col("s").alias("label")),
        F.struct(F.lit("source_type").alias("dimension"), F.col("k").alias("label")))).alias("p"))
    return long.groupBy("p.dimension", "p.label").agg(F.sum("c").alias("row_count"))


def store_quality(history: DataFrame, assets: DataFrame, facts: Mapping[str, DataFrame]) -> DataFrame:
    """Counts over the stored tables as (metric, value)."""
    report = quality_report(history).drop("first_ts", "last_ts")
    long = report.unpivot([], report.columns, "metric", "value")
    for name, table in {"registered_assets": assets, **facts}.items():
        long = long.unionByName(table.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value"))
    return long


def provenance_summary(df: DataFrame) -> DataFrame:
    """Rows and percentage per provenance; the total is taken over at most four rows."""
    counts = df.groupBy("source_type").agg(F.count(F.lit(1)).alias("row_count"))
    total = F.sum("row_count").over(Window.partitionBy())
    return counts.withColumn("percentage", F.round(F.col("row_count") / total * 100.0, 1))


def provenance_label(df: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """REAL or DERIVED only when every row is; anything else is SYNTHETIC."""
    kinds = df.groupBy(*keys).agg(
        F.min("source_type").alias("lo"), F.max("source_type").alias("hi"),
        F.count_if(F.col("source_type").isNull()).alias("gaps"))
    pure = (F.col("lo") == F.col("hi")) & (F.col("gaps") == 0) & F.col("lo").isin("REAL", "DERIVED")
    return kinds.select(*keys, F.when(pure, F.col("lo")).otherwise("SYNTHETIC").alias("provenance"))


def violated(rules: Mapping[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.expr(pred), F.lit(name)) for name, pred in rules.items()]))


def check_contract(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy every rule, the others with a `reasons` array)."""
    tagged = df.withColumn("reasons", violated(rules))
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def contract_counts(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """rule -> number of violations, in one pass."""
    counts = df.agg(*[F.count_if(~F.expr(pred)).alias(name) for name, pred in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def run_checks(df: DataFrame, assets: DataFrame, now: Column) -> DataFrame:
    """(check, violations): future rows, duplicate keys, values that are not positive, unknown assets, bad provenance."""
    per_row = df.agg(
        F.count_if(F.col("timestamp") > now).alias("future_timestamp"),
        F.count_if(~F.coalesce(F.col("production") > 0, F.lit(False))).alias("not_positive"),
        F.count_if(~F.coalesce(F.col("source_type").isin("REAL", "SYNTHETIC", "DERIVED"), F.lit(False))).alias("bad_provenance"))
    long = per_row.unpivot([], per_row.columns, "check_name", "violations")
    dups = duplicate_count(df).select(F.lit("duplicate_key").alias("check_name"), F.col("duplicate_count").alias("violations"))
    per_asset = df.groupBy("asset_id").agg(F.count(F.lit(1)).alias("c"))
    orphans = per_asset.join(assets.select("asset_id"), "asset_id", "left_anti").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("violations")).select(F.lit("unknown_asset").alias("check_name"), "violations")
    return long.unionByName(dups).unionByName(orphans)


def out_of_order(df: DataFrame, arrival: Sequence[str], slice_unit: str | float | None = 1_000_000) -> DataFrame:
    """Per asset: rows whose timestamp is before that of the row that arrived just before them.

    An asset is split over slices of the first arrival column: a width for a number, a calendar unit for a time.
    """
    flagged = over_slices(
        df.select("asset_id", "timestamp", *[c for c in arrival if c not in ("asset_id", "timestamp")]),
        ["asset_id"], list(arrival), lambda w: {"_prev": F.lag("timestamp").over(w)}, 1, arrival[0], slice_unit)
    return flagged.groupBy("asset_id").agg(F.count_if(F.col("timestamp") < F.col("_prev")).alias("out_of_order"))
