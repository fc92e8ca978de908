"""Exact interpolated percentiles per group.

method "sort" uses the built-in exact percentile, which keeps every distinct value of a group in one task; use it for
bounded groups. method "bracket" is a distributed radix selection: doubles become 64-bit codes of the same order, rows are
counted by the leading twelve bits in which a group's codes still differ, and only the bucket that holds the wanted rank
is counted again by its next bits. Twelve bits a round end after six rounds at the latest; in practice one round settles
groups of up to 2,048 rows and two groups of some millions. No group is held or sorted whole: what is ordered is at most
4,097 bucket counts of one group and rank. It reads the rows once for the counts and once a round, each time with partial
sums in the map tasks; the counts (a row per group and percentile) are pinned by a checkpoint, which runs a job. They are
broadcast while the groups are counted to be at most 500,000; beyond, they meet the rows in a plain join.

Both methods keep the group of NULL keys, leave NULL values out, order NaN after every number, give NULL percentiles to a
group without values, and return one row for an empty input without keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.session import BROADCAST_ROWS, cut_lineage

_BITS = 12
_FEW = 1 << (_BITS - 1)
_ROUNDS = 6


def group_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], method: str = "bracket",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key: the named percentiles of `value`, its non-null count `n`, and any extra aggregates."""
    if method == "sort":
        wanted = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
        out = df.groupBy(*keys).agg(F.count(value).alias("n"), wanted.alias("_q"), *extra)
        return out.withColumns({name: F.col("_q")[i] for i, name in enumerate(probs)}).drop("_q")
    return _selected(df, list(keys), value, probs, extra)


def with_order_code(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds `name`, a long of the same order as the double `value`: equal values share a code, NaN comes last.

    Exponent and fraction are taken by arithmetic that is exact in doubles (powers of two), so neighbouring doubles get
    neighbouring codes; a logarithm that is rounded across a power of two is put right by the two comparisons. The steps are
    columns of their own, so that each is computed once a row.
    """
    two, top = F.lit(2.0), F.lit(2047 << 52)
    size, rough, exponent = F.col(f"{name}_size"), F.col(f"{name}_rough"), F.col(f"{name}_exponent")
    steps = df.withColumn(f"{name}_size", F.abs(F.col(value).cast("double")))
    steps = steps.withColumn(f"{name}_rough", F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)))
    corrected = (F.when(size < F.pow(two, rough), rough - 1)
                 .when((rough < 1023) & (size >= F.pow(two, rough + 1)), rough + 1).otherwise(rough))
    steps = steps.withColumn(f"{name}_exponent", F.greatest(corrected, F.lit(-1022)))
    # numbers below the smallest normal one keep the lowest exponent and a fraction below 1
    fraction = (size / F.pow(two, exponent)) * F.lit(float(1 << 52))
    code = (exponent + 1022) * F.lit(1 << 52) + fraction.try_cast("long")
    steps = steps.withColumn(name, (
        F.when(F.isnan(size), top + 1).when(size == 0, F.lit(0)).when(size == F.lit(float("inf")), top).otherwise(code)
    ) * F.when(F.col(value) < 0, F.lit(-1)).otherwise(F.lit(1)))
    return steps.drop(f"{name}_size", f"{name}_rough", f"{name}_exponent")


def _dropped_bits(lo: Column, hi: Column, rows: Column) -> Column:
    """How many low bits of the codes a bracket's buckets leave out: at most 2^12 + 1 buckets remain. Few rows need none."""
    half = F.call_function("shiftright", hi, F.lit(1)) - F.call_function("shiftright", lo, F.lit(1))
    return F.when(rows <= _FEW, F.lit(0)).otherwise(F.greatest(F.length(F.bin(half)) + 1 - _BITS, F.lit(0)))


def _narrowed(rows: DataFrame, state: DataFrame, brackets: dict[int, list[int]]) -> DataFrame:
    """One round: for each open (group, percentile) the bucket that holds its rank, as the next bracket.

    `brackets` names the percentiles that look for their rank in a bracket: all of them share the first one, so a row is
    counted once there. `need` is the wanted rank within the bracket, `step` is 1 if the rank above it is wanted too, `high`
    that rank's value once it lies outside the bracket, `low` the wanted value once the bracket holds one value only.
    """
    def within(j: int) -> Column:
        return F.col("_v").between(F.col(f"_t{j}.lo"), F.col(f"_t{j}.hi"))

    def bucket(j: int) -> Column:
        return F.struct(F.lit(j).alias("j"), F.call_function("shiftright", F.col("_c"), F.col(f"_t{j}.drop")).alias("b"))

    held = rows.join(state, "_g").where(reduce(Column.__or__, [within(j) for j in brackets]))
    held = with_order_code(held, "_v", "_c")  # only of rows inside a bracket
    if len(brackets) == 1:
        held = held.withColumn("_h", bucket(next(iter(brackets))))
    else:
        held = held.withColumn("_h", F.explode(F.array_compact(F.array(*[F.when(within(j), bucket(j)) for j in brackets]))))
    counted = held.groupBy("_g", F.col("_h.j").alias("_j"), F.col("_h.b").alias("_b")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    order = Window.partitionBy("_g", "_j").orderBy("_b")
    upto = F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumns({"_upto": upto, "_above": F.lead("lo").over(order)}).join(state, "_g")
    wanted = F.coalesce(*[
        F.when(F.col("_j") == j, F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(f"_w{i}").alias("w")) for i in here]))
        for j, here in brackets.items()])
    ranked = ranked.withColumn("_t", F.explode(wanted))
    below, need, step = F.col("_upto") - F.col("_rows"), F.col("_t.w.need"), F.col("_t.w.step")
    single = F.col("lo") == F.col("hi")
    chosen = ranked.where((F.col("_upto") > need) & (below <= need))
    picked = with_order_code(with_order_code(chosen, "lo", "_lo"), "hi", "_hi")
    return cut_lineage(picked.select(
        "_g", F.col("_t.i").alias("i"), "lo", "hi", _dropped_bits(F.col("_lo"), F.col("_hi"), F.col("_rows")).alias("drop"),
        (need - below).alias("need"), step.alias("step"), F.col("_t.w.share").alias("share"),
        F.when(single, F.col("lo")).alias("low"),
        F.when(F.col("_upto") > need + step, F.when(single, F.col("lo")))
        .otherwise(F.coalesce("_above", "_t.w.high")).alias("high")))


def _selected(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], extra: Sequence[Column]) -> DataFrame:
    # a struct of the keys joins NULL keys too
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1).alias("all"))
    number = F.col(value).cast("double")
    totals = cut_lineage(df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(number).alias("_min"), F.max(number).alias("_max"), *extra)).withColumn("_g", group)
    rows = df.select(group.alias("_g"), number.alias("_v")).where(F.col("_v").isNotNull())

    coded = with_order_code(with_order_code(totals.where(F.col("n") > 0), "_min", "_lo"), "_max", "_hi")
    bracket = F.struct(
        F.col("_min").alias("lo"), F.col("_max").alias("hi"), _dropped_bits(F.col("_lo"), F.col("_hi"), F.col("n")).alias("drop"))
    ranks = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        ranks.append(F.struct(
            F.floor(pos).alias("need"), (F.ceil(pos) - F.floor(pos)).alias("step"), (pos - F.floor(pos)).alias("share"),
            F.lit(None).cast("double").alias("high")).alias(f"_w{i}"))
    state = coded.select("_g", bracket.alias("_t0"), *ranks)

    few = totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    settled, brackets = [], {0: list(range(len(probs)))}
    for _ in range(_ROUNDS):
        found = _narrowed(rows, F.broadcast(state) if few else state, brackets)
        settled.append(found.where(F.col("low").isNotNull()))
        still = found.where(F.col("low").isNull())
        places = sorted(r.i for r in still.select("i").distinct().collect())
        if not places:
            break
        brackets = {i: [i] for i in places}
        one = {i: F.col("i") == i for i in places}
        state = still.groupBy("_g").agg(
            *[F.max(F.when(one[i], F.struct("lo", "hi", "drop"))).alias(f"_t{i}") for i in places],
            *[F.max(F.when(one[i], F.struct("need", "step", "share", "high"))).alias(f"_w{i}") for i in places])
    even = F.col("low") == F.col("high")
    exact = F.when(even, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    wide = reduce(DataFrame.unionByName, settled).groupBy("_g").agg(*[
        F.max(F.when(F.col("i") == i, exact)).alias(name) for i, name in enumerate(probs)])
    return totals.drop("_min", "_max").join(wide, "_g", "left").drop("_g")
