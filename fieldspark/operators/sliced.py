"""Ordered per-key operations that split a key over time slices.

A plain window partitioned by the key puts all rows of that key into one task. When one asset may hold a large share
of a telemetry table, these helpers partition by (key, slice) instead and carry the little that crosses a slice
border: row counts, the last rows of the slices before, or the nearest known value. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
HALO = "_halo"


def add_slice(df: DataFrame, time_col: str, unit: str | float = "day") -> DataFrame:
    """Slices of a calendar unit for a time column, or of a width for a number."""
    at = F.date_trunc(unit, F.col(time_col)) if isinstance(unit, str) else F.floor(F.col(time_col) / F.lit(unit))
    return df.withColumn(SLICE, at)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time_col: str, unit: str = "month",
    name: str = "row_number", total: str | None = None,
) -> DataFrame:
    """1-based row number per key (and optionally the group size), computed slice by slice."""
    sliced = add_slice(df, time_col, unit)
    per_key = Window.partitionBy(*keys)
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = per_key.orderBy(F.col(SLICE).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(SLICE).alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(per_key).alias("_total"),
    )
    match = sliced[SLICE].eqNullSafe(counts["_s"])
    for k in keys:
        match = match & sliced[k].eqNullSafe(counts[f"_k_{k}"])
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    out = sliced.join(counts, match).withColumn(name, F.row_number().over(inside) + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop(SLICE, "_s", "_before", "_total", *[f"_k_{k}" for k in keys])


def with_halo(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time_col: str, back: int, unit: str | float = "day",
) -> DataFrame:
    """Rows plus, per slice, copies (`_halo` true) of the `back` rows that precede the slice.

    Reads its input twice. Chained calls multiply that, so put expressions with the same order into one call and store
    intermediate tables between stages.
    """
    sliced = add_slice(df, time_col, unit)
    cols = df.columns
    last = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        sliced.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= back)
        .groupBy(*keys, SLICE)
        .agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(-back, -1)
    carried = tails.select(*keys, SLICE, F.flatten(F.collect_list("_tail").over(earlier)).alias("_carry"))
    carried = carried.select(
        SLICE, F.explode(F.when(F.size("_carry") > back, F.slice("_carry", -back, back)).otherwise(F.col("_carry"))
                         ).alias("_row"))
    halo = carried.select(*[F.col("_row")[c].alias(c) for c in cols], SLICE, F.lit(True).alias(HALO))
    return sliced.withColumn(HALO, F.lit(False)).unionByName(halo)


def over_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], exprs: Callable[[Window], dict[str, Column]],
    back: int, time_col: str, unit: str | float | None = "day",
) -> DataFrame:
    """Add window expressions that look at most `back` rows behind.

    `exprs` gets the ordered window and returns name -> expression. With unit None the plain window is used, which
    suits panels whose groups are bounded (one row per asset and month).
    """
    if unit is None:
        return df.withColumns(exprs(Window.partitionBy(*keys).orderBy(*order)))
    rows = with_halo(df, keys, order, time_col, back, unit)
    window = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return rows.withColumns(exprs(window)).where(~F.col(HALO)).drop(HALO, SLICE)


def neighbours(
    df: DataFrame, keys: Sequence[str], time_col: str, cols: Sequence[str], unit: str = "month",
) -> DataFrame:
    """Add `_prev_c` and `_next_c` structs (ts, v): the nearest known value of c at or before, at or after."""
    sliced = add_slice(df, time_col, unit)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(time_col).alias("ts"), F.col(c).alias("v"))) for c in cols}
    aggs = []
    for c in cols:
        aggs += [F.max(known[c]).alias(f"_last_{c}"), F.min(known[c]).alias(f"_first_{c}")]
    edges = sliced.groupBy(*keys, SLICE).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    carry = edges.select(
        *keys, SLICE,
        *[F.max(f"_last_{c}").over(before).alias(f"_cp_{c}") for c in cols],
        *[F.min(f"_first_{c}").over(after).alias(f"_cn_{c}") for c in cols],
    )
    upto = Window.partitionBy(*keys, SLICE).orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*keys, SLICE).orderBy(time_col).rowsBetween(0, Window.unboundedFollowing)
    out = sliced.join(carry, [*keys, SLICE], "left")
    new = {}
    for c in cols:
        new[f"_prev_{c}"] = F.coalesce(F.last(known[c], ignorenulls=True).over(upto), F.col(f"_cp_{c}"))
        new[f"_next_{c}"] = F.coalesce(F.first(known[c], ignorenulls=True).over(onward), F.col(f"_cn_{c}"))
    return out.withColumns(new).drop(SLICE, *[f"_cp_{c}" for c in cols], *[f"_cn_{c}" for c in cols])
