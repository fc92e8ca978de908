"""Cleaning of telemetry rows. Every step is lazy; counts come from `observe` or from the quality report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldspark.config import UNIT_BOUNDS, CleanConfig
from fieldspark.functions.columns import safe_div
from fieldspark.operators import sliced
from fieldspark.operators.quantiles import group_percentiles
from fieldspark.schema import MEASURES, STANDARD
from fieldspark.session import join_checked, observed, scratch_path

KEY = ("asset_id", "timestamp")


def normalize_ts(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Timestamps in the session zone (UTC); unreadable text becomes NULL."""
    return df.withColumn(col, F.col(col).try_cast("timestamp"))


def _required() -> Column:
    return (F.col("asset_id").isNotNull() & (F.trim("asset_id") != "") & F.col("timestamp").isNotNull()
            & F.col("production").isNotNull())


def drop_missing_required(df: DataFrame) -> DataFrame:
    return df.where(_required())


def convert_units(df: DataFrame, factors: Mapping[str, tuple[str, float]]) -> DataFrame:
    """column -> (source unit, factor to the canonical unit); columns that are absent are skipped."""
    present = {c: F.col(c).try_cast("double") * F.lit(float(f)) for c, (_, f) in factors.items() if c in df.columns}
    return df.withColumns(present) if present else df


def enforce_positive(df: DataFrame, strict: bool = True) -> DataFrame:
    value = F.col("production").try_cast("double")
    if strict:
        return df.where(value.isNotNull() & (value >= 0))
    return df.withColumn("production", F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))))


def _outside(col: str, bounds: tuple[float, float]) -> Column:
    value = F.col(col).try_cast("double")
    return F.coalesce((value < bounds[0]) | (value > bounds[1]), F.lit(False))


def violation_flags(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = UNIT_BOUNDS) -> dict[str, Column]:
    return {c: _outside(c, b) for c, b in bounds.items() if c in df.columns}


def validate_units(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = UNIT_BOUNDS) -> DataFrame:
    """Drop a row if any measure lies outside its plausible range."""
    keep = F.lit(True)
    for bad in violation_flags(df, bounds).values():
        keep = keep & ~bad
    return df.where(keep)


def unit_violations(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = UNIT_BOUNDS) -> DataFrame:
    """One row: violations per measure and rows with any."""
    flags = violation_flags(df, bounds)
    anywhere = F.lit(False)
    for bad in flags.values():
        anywhere = anywhere | bad
    return df.agg(*[F.count_if(bad).alias(f"{c}_violations") for c, bad in flags.items()],
                  F.count_if(anywhere).alias("rows_dropped"))


def dedupe(df: DataFrame, order: Sequence[str], keep: str = "last", keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the first or last in the caller's total order.

    An aggregate, not a window: copies of one key are reduced in every map task before the shuffle.
    """
    place = F.struct(*[F.col(c) for c in order])
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), place).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def impute_time(df: DataFrame, cols: Sequence[str] = MEASURES, slice_unit: str = "month") -> DataFrame:
    """Time-weighted linear interpolation in both directions, only for assets without any REAL row.

    Needs one row per (asset, timestamp). An asset is split over time slices, so a large one spreads over many tasks.
    """
    real = (df.groupBy("asset_id").agg(F.bool_or(F.col("source_type") == "REAL").alias("_real")))
    held = df.join(real, "asset_id").withColumn("_real", F.coalesce(F.col("_real"), F.lit(False)))
    near = sliced.neighbours(held, ["asset_id"], "timestamp", cols, slice_unit)
    at = F.unix_micros("timestamp").cast("double")
    new = {}
    for c in cols:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        start, end = F.unix_micros(prev["ts"]).cast("double"), F.unix_micros(nxt["ts"]).cast("double")
        share = F.coalesce(safe_div(at - start, end - start), F.lit(0.0))
        blend = F.when(prev.isNotNull() & nxt.isNotNull(), prev["v"] + (nxt["v"] - prev["v"]) * share)
        filled = F.coalesce(F.col(c), blend, prev["v"], nxt["v"])
        new[c] = F.when(F.col("_real"), F.col(c)).otherwise(filled)
    return near.withColumns(new).select(*df.columns)


def outlier_flags(
    df: DataFrame, method: str = "mad_z", threshold: float = 3.5, k: float = 3.0, value: str = "production",
    keys: Sequence[str] = ("asset_id",), exact: str = "bracket",
) -> DataFrame:
    """Adds `is_outlier`. MAD z-score with a population-std fallback, or the IQR rule.

    Statistics come from aggregates joined back on the key, never from a window over all rows of an asset. With exact
    "bracket" the statistics (one row per key) come from pinned counts, and the rows are shuffled not at all while there are
    few enough keys to broadcast them; "sort" is one lazy plan for bounded groups.
    """
    keys = list(keys)
    join = join_checked if exact == "bracket" else (lambda d, side, on, how: d.join(side, on, how))
    if method == "iqr":
        q = group_percentiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75}, exact).drop("n")
        spread = F.col("_q3") - F.col("_q1")
        bad = (F.col(value) < F.col("_q1") - k * spread) | (F.col(value) > F.col("_q3") + k * spread)
        return join(df, q, keys, "left").withColumn("is_outlier", F.coalesce(bad, F.lit(False))).drop("_q1", "_q3")
    med = group_percentiles(
        df, keys, value, {"_med": 0.5}, exact,
        extra=[F.stddev_pop(value).alias("_std"), F.min(value).alias("_low"), F.max(value).alias("_high")]).drop("n")
    dev = F.abs(F.col(value) - F.col("_med"))
    centred = join(df, med, keys, "left").withColumn("_dev", dev)
    mad = group_percentiles(centred.select(*keys, "_dev"), keys, "_dev", {"_mad": 0.5}, exact).drop("n")
    z = F.when(F.col("_mad") > 0, 0.6745 * F.col("_dev") / F.when(F.col("_mad") > 0, F.col("_mad"))).when(
        (F.col("_high") > F.col("_low")) & (F.col("_std") > 0), safe_div(F.col("_dev"), F.col("_std")))
    return (join(centred, mad, keys, "left").withColumn("is_outlier", F.coalesce(z > threshold, F.lit(False)))
            .drop("_med", "_std", "_low", "_high", "_dev", "_mad"))


def drop_outliers(df: DataFrame, flag_only: bool = False) -> DataFrame:
    return df if flag_only else df.where(~F.col("is_outlier")).drop("is_outlier")


def resample_monthly(df: DataFrame) -> DataFrame:
    """Monthly means per asset; text columns take their first known value in time order."""
    def first(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct("timestamp", c)))[c].alias(c)

    out = df.groupBy("asset_id", F.date_trunc("month", "timestamp").alias("_month")).agg(
        F.avg("production").alias("production"), *[F.avg(c).alias(c) for c in MEASURES],
        F.count(F.lit(1)).alias("sample_count"), F.min("production").alias("production_min"),
        F.max("production").alias("production_max"), first("valve_status"), first("source"), first("source_type"))
    return out.withColumnRenamed("_month", "timestamp")


def monthly_panel(df: DataFrame, value: str = "production", how: str = "avg") -> DataFrame:
    """Telemetry -> MONTHLY rows (asset_id, period, t, actual). Groups are bounded by the number of months."""
    agg = {"avg": F.avg, "sum": F.sum}[how]
    months = df.groupBy("asset_id", F.to_date(F.date_trunc("month", "timestamp")).alias("period")).agg(
        agg(value).alias("actual"))
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy("period")) - 1
    return months.withColumn("t", rank.cast("int")).select("asset_id", "period", "t", "actual")


def clean_monthly(df: DataFrame, order: Sequence[str], value: str = "actual") -> DataFrame:
    """Monthly clean-up: non-negative, last row per month wins, missing expectation = trailing six-month mean."""
    good = dedupe(df.where(F.col(value).isNotNull() & (F.col(value) >= 0)), order, "last", ("asset_id", "period"))
    trailing = Window.partitionBy("asset_id").orderBy("period").rowsBetween(-5, 0)
    mean = F.avg(value).over(trailing)
    known = F.col("expected") if "expected" in df.columns else F.lit(None).cast("double")
    return good.withColumn("expected", F.coalesce(known, mean))


def chrono_split(df: DataFrame, train_fraction: float = 0.8, order: Sequence[str] = ("timestamp",),
                 slice_unit: str = "month") -> DataFrame:
    """Adds `split` (train/test): the first int(n*f) rows of each asset, at least one on each side when n > 1."""
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must lie strictly between 0 and 1")
    numbered = sliced.row_numbers(df, ["asset_id"], order, "timestamp", slice_unit, "_rn", "_n")
    cut = F.floor(F.col("_n") * F.lit(float(train_fraction)))
    cut = F.when(F.col("_n") > 1, F.least(F.greatest(cut, F.lit(1)), F.col("_n") - 1)).otherwise(F.col("_n"))
    return numbered.withColumn("split", F.when(F.col("_rn") <= cut, "train").otherwise("test")).drop("_rn", "_n")


def clean(df: DataFrame, order: Sequence[str], config: CleanConfig = CleanConfig(), stage: bool = True) -> tuple[DataFrame, Observation]:
    """The full cleaning order; the observation holds the counts of the row-level steps once the frame is used.

    Imputation and outlier statistics read the rows several times. With `stage` the de-duplicated rows are written once to
    a table in the shared folder and those passes read only the columns they need from it; without, the plan stays lazy up
    to the pinned statistics and repeats the steps before.
    """
    seen = Observation("clean")
    stamped = convert_units(normalize_ts(df), config.units)
    missing = ~_required()
    negative = F.coalesce(F.col("production") < 0, F.lit(False))
    outside = F.lit(False)
    for bad in violation_flags(stamped).values():
        outside = outside | bad
    counted = stamped.observe(
        seen, F.count(F.lit(1)).alias("input_rows"), F.count_if(missing).alias("missing_required_dropped"),
        F.count_if(~missing & negative).alias("negative_dropped"),
        F.count_if(~missing & ~negative & outside).alias("unit_validation_failures"))
    out = validate_units(enforce_positive(drop_missing_required(counted), config.negatives == "drop"))
    if config.copies is not None:
        out = dedupe(out, order, config.copies)
    if stage and (config.impute or config.outliers is not None):
        place = scratch_path(df.sparkSession, "clean")
        out.write.parquet(place)
        out = df.sparkSession.read.parquet(place)
    if config.impute:
        out = impute_time(out)
    if config.outliers is not None:
        out = drop_outliers(outlier_flags(out, config.outliers.rule, config.outliers.limit, config.outliers.limit))
    if config.monthly:
        out = resample_monthly(out)
    return out, seen


def clean_counted(df: DataFrame, order: Sequence[str], config: CleanConfig = CleanConfig()) -> tuple[DataFrame, dict[str, int]]:
    """The cleaned rows as a stored table, and the figures of every step, gathered by the jobs that do the work.

    Rows are counted by the first rule that drops them, violations per measure among the rows that reach the range check,
    imputed values per measure. The rows are written once after the row-level steps, once more where they are imputed, and at
    the end. A step that the configuration leaves out counts zero.
    """
    spark = df.sparkSession

    def stored(frame: DataFrame, what: str, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
        seen, place = Observation(), scratch_path(spark, f"clean-{what}")
        named = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()]]
        frame.observe(seen, *named).write.parquet(place)
        out = spark.read.schema(frame.schema).parquet(place)
        return out, observed(seen, out, named)

    stamped = convert_units(normalize_ts(df), config.units)
    present, negative = _required(), F.coalesce(F.col("production") < 0, F.lit(False))
    reaches = present & ~negative if config.negatives == "drop" else present
    flags = violation_flags(stamped)
    if config.negatives != "drop":  # a negative rate becomes zero before the range check
        flags["production"] = flags["production"] & ~negative
    outside = F.lit(False)
    for bad in flags.values():
        outside = outside | bad
    rows_in = Observation()
    steps = [
        F.count(F.lit(1)).alias("input_rows"), F.count_if(~present).alias("missing_required_dropped"),
        F.count_if(present & negative).alias("negatives"), F.count_if(reaches & outside).alias("unit_rows_dropped"),
        *[F.count_if(reaches & bad).alias(f"{c}_violations") for c, bad in flags.items()]]
    out = validate_units(enforce_positive(drop_missing_required(stamped.observe(rows_in, *steps)), config.negatives == "drop"))
    if config.copies is not None:
        out = dedupe(out, order, config.copies)
    measures = [c for c in MEASURES if c in df.columns]
    gaps = {c: F.count_if(F.col(c).isNull()) for c in measures}
    out, base = stored(out, "rows", **gaps)
    seen = observed(rows_in, stamped, steps)
    dropped = seen["negatives"] if config.negatives == "drop" else 0
    report = {k: v for k, v in seen.items() if k != "negatives"}
    report |= {"negative_dropped": dropped, "negative_zeroed": seen["negatives"] - dropped}
    report["duplicates_removed"] = (
        seen["input_rows"] - seen["missing_required_dropped"] - dropped - seen["unit_rows_dropped"] - base["rows"])
    if config.impute:
        out, after = stored(impute_time(out, measures), "imputed", **gaps)
    report |= {f"{c}_imputed": base[c] - after[c] if config.impute else 0 for c in measures}
    flagged = Observation()
    report |= {"outliers_flagged": 0, "outliers_removed": 0}
    if config.outliers is not None:
        marked = outlier_flags(out, config.outliers.rule, config.outliers.limit, config.outliers.limit)
        out = drop_outliers(marked.observe(flagged, F.count_if("is_outlier").alias("n")))
    if config.monthly:
        out = resample_monthly(out)
    out, final = stored(out, "out", **{f"missing_{c}": F.count_if(F.col(c).isNull()) for c in STANDARD if c in out.columns})
    if config.outliers is not None:
        report |= dict.fromkeys(("outliers_flagged", "outliers_removed"), observed(flagged, marked, [F.count_if("is_outlier").alias("n")])["n"])
    left = base["rows"] - report["outliers_removed"]
    report |= {"monthly_input_rows": left if config.monthly else 0, "monthly_output_rows": final["rows"] if config.monthly else 0}
    return out, report | {"output_rows": final["rows"]} | {k: v for k, v in final.items() if k != "rows"}
