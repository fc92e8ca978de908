"""Rank over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.session import cut_lineage


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position in the given total order.

    The rows are range-partitioned and sorted once and pinned with a checkpoint; the position is the partition's offset
    plus the row's place in its partition. Only one count per partition goes through a single task.
    """
    pinned = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = pinned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        pinned.join(F.broadcast(offsets), part == F.col("_part"))  # one row per partition
        .withColumn(name, F.col("_before") + place + 1).drop("_mid", "_part", "_before"))
