"""Interval joins as a sweep in slices: an interval is one row however long it is, and rows never meet in pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_covered(df: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float,
                 name: str = "covered") -> DataFrame:
    """Adds a flag: does any interval of the key contain the value? Ends included; rows are never multiplied.

    A value is covered where the furthest end of the intervals that start at or before it reaches it. Each key is cut into
    slices of `width`: a slice sweeps its own starts and values, and gets the furthest end of the slices before as one row.
    Only the table of slices sees a key whole. NULL keys, values and bounds and reversed intervals cover nothing.
    """
    ids = [f"_k{i}" for i in range(len(keys))]

    def sliced(col: Column) -> Column:
        return F.floor(col / F.lit(float(width)))

    known = intervals.where(F.col(start) <= F.col(end))
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    starts = known.groupBy(*[F.col(k).alias(i) for k, i in zip(keys, ids)], F.col(start).alias("_pos")).agg(F.max(end).alias("_reach"))
    starts = starts.withColumn("_cell", sliced(F.col("_pos")))
    values = df.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], F.col(at).alias("_pos"), sliced(F.col(at)).alias("_cell"),
                       F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    # the furthest end of all slices before, for the slices that hold values
    cells = starts.groupBy(*ids, "_cell").agg(F.max("_reach").alias("_far"), F.lit(False).alias("_used")).unionByName(
        values.select(*ids, "_cell").distinct().withColumn("_used", F.lit(True)), allowMissingColumns=True)
    cells = cells.groupBy(*ids, "_cell").agg(F.max("_far").alias("_far"), F.bool_or("_used").alias("_used"))
    before = Window.partitionBy(*ids).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("_reach", F.max("_far").over(before)).where(F.col("_used") & F.col("_reach").isNotNull())
    rows = values.withColumn("_kind", F.lit(1)).unionByName(
        starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True).unionByName(
        carried.select(*ids, "_cell", "_reach", F.lit(-1).alias("_kind")), allowMissingColumns=True)
    # a carried row has no place and comes first; at one place starts come before values
    upto = Window.partitionBy(*ids, "_cell").orderBy(F.col("_pos").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("_upto", F.max("_reach").over(upto)).where(F.col("_kind") == 1)
    return swept.select("_row.*", F.coalesce(F.col("_upto") >= F.col("_pos"), F.lit(False)).alias(name))
