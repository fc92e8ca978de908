"""Model-estimated feature contributions by mean ablation. They describe the model, not a physical cause."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Predict = Callable[[DataFrame], DataFrame]  # adds `prediction` from the array column `features`


def model_predict(model: Model) -> Predict:
    def predict(df: DataFrame) -> DataFrame:
        return model.transform(df.withColumn("vector", array_to_vector("features"))).drop("vector")
    return predict


def linear_predict(coefficients: Sequence[float], intercept: float = 0.0) -> Predict:
    total = F.lit(float(intercept))
    for i, c in enumerate(coefficients):
        total = total + F.col("features")[i] * float(c)
    return lambda df: df.withColumn("prediction", total)


def background_rows(rows: DataFrame, size: int | None = None, seed: int = 42) -> DataFrame:
    """All rows: a monthly panel is bounded by the calendar. With `size` a sample of at most so many rows per asset, by hash
    order of (seed, asset, t), cut before the shuffle; the contributions are then estimates."""
    if size is None:
        return rows
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "asset_id", F.col("t").cast("string")))
    w = Window.partitionBy("asset_id").orderBy(order, "t")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop("_rn")


def last_rows(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in ("asset_id", "t")]
    return rows.groupBy("asset_id").agg(F.max_by(F.struct("t", *others), "t").alias("r")).select("asset_id", "r.*")


def ablation_contributions(instances: DataFrame, background: DataFrame, names: Sequence[str], predict: Predict) -> DataFrame:
    """Per instance and feature: mean prediction over its asset's background rows with that feature set to the instance's
    value, minus the mean prediction of the background itself (`base`).

    An equi-join on the asset; background rows x (features + 1) rows per instance, reduced in the map tasks.
    """
    mine = instances.select("asset_id", F.col("features").alias("_x"))
    pairs = background.select("asset_id", F.col("features").alias("_bg")).join(mine, "asset_id")
    slots = F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))).alias("_j")
    swapped = pairs.select("asset_id", "_x", "_bg", slots).select(
        "asset_id", "_x", "_j", F.transform("_bg", lambda v, i: F.when(i == F.col("_j"), F.get("_x", i)).otherwise(v)).alias("features"))
    means = predict(swapped).groupBy("asset_id", "_j").agg(F.avg("prediction").alias("m"), F.first("_x").alias("_x"))
    base = F.max(F.when(F.col("_j") == -1, F.col("m"))).over(Window.partitionBy("asset_id"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_j") + 1)
    return means.withColumn("base", base).where(F.col("_j") >= 0).select(
        "asset_id", label.alias("feature"), F.get("_x", F.col("_j")).alias("value"), "base",
        (F.col("m") - F.col("base")).alias("contribution"))


def contribution_table(contributions: DataFrame, top: int = 6, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Direction, share of the absolute total, and rank; the strongest `top` per key."""
    w = Window.partitionBy(*keys)
    total = F.sum(F.abs("contribution")).over(w)
    share = F.when(total > 1e-12, F.abs("contribution") / total * 100.0).otherwise(0.0)
    ranked = contributions.withColumn("share_pct", share)
    order = w.orderBy(F.round("share_pct", 9).desc(), "feature")
    out = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.withColumn("direction", F.when(F.col("contribution") >= 0, "UPWARD").otherwise("DOWNWARD"))


def waterfall(table: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Running start and end from the base through the ranked contributions."""
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum("contribution").over(w)
    return table.withColumn("end", end).withColumn("start", F.col("end") - F.col("contribution"))


def attribute_deviation(state: DataFrame, table: DataFrame) -> DataFrame:
    """One row per asset: expected, actual, gap and the ranked contributions as a bounded array."""
    packed = table.groupBy("asset_id").agg(
        F.max("base").alias("base"),
        F.sort_array(F.collect_list(F.struct("rank", "feature", "value", "contribution", "share_pct", "direction"))).alias("contributions"))
    return state.select("asset_id", "period", "expected", "actual", (F.col("actual") - F.col("expected")).alias("gap_signed")).join(
        packed, "asset_id", "left")
