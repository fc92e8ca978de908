"""Keyed state for readings: each one meets the readings of its asset before it, in event-time order.

The state of an asset holds the last rows that were passed on and the rows that wait for the watermark, nothing else. Rows are
passed on when no earlier one can come any more, so the result equals the batch operators whatever the order of arrival within
the lateness bound, the cut into micro-batches and restarts. Spark drops rows behind the watermark and counts them in the
progress of the query (numRowsDroppedByWatermark). An operator that looks back on the result of another one reads the table
that it appends to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldspark.streaming.telemetry import events_of, with_lateness

#: State on the executors' disks, written to the checkpoint by changes.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "passed long, place long, ts array<long>, rows array<string>"
OUT = "asset_id string, ts long, _row string, _past array<string>, place long"


def merge_readings(waiting: list[tuple[int, str]], passed: list[tuple[int, str]], new: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The waiting rows with the new ones, in order. Of one time the row that came first stays (of one batch: the smallest)."""
    known = {ts for ts, _ in passed} | {ts for ts, _ in waiting}
    last = passed[-1][0] if passed else None
    for ts, row in sorted(new):
        if ts not in known and (last is None or ts > last):
            known.add(ts)
            waiting.append((ts, row))
    return sorted(waiting)


def with_past(stream: DataFrame, cols: Sequence[str], back: int) -> DataFrame:
    """asset_id, timestamp, cols, `past` (array of structs of cols: the `back` rows before, oldest first) and `place` (rows of
    the asset before it), one row per asset and time.

    stream has a watermark on timestamp; rows without asset or time are left out. Values travel as JSON, so any types that
    JSON keeps can be looked back on. The state of an asset that sends nothing stays.
    """
    kept = T.StructType([stream.schema[c] for c in cols])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, place, times, rows = state.get if state.exists else (0, 0, [], [])
        held = list(zip(times, rows, strict=True))
        passed, waiting = held[:n], held[n:]
        new = [] if state.hasTimedOut else [x for f in frames for x in zip(f["ts"].tolist(), f["_row"].tolist(), strict=True)]
        waiting = merge_readings(waiting, passed, new)
        mark = state.getCurrentWatermarkMs()
        ready = [x for x in waiting if x[0] <= mark * 1000]
        out = []
        for ts, row in ready:
            out.append((key[0], ts, row, [r for _, r in passed], place))
            passed, place = (passed + [(ts, row)])[-back:], place + 1
        waiting = waiting[len(ready):]
        held = passed + waiting
        state.update((len(passed), place, [ts for ts, _ in held], [r for _, r in held]))
        if waiting:  # called again when the watermark reaches the first of them, also without new rows
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 - 1, mark + 1))
        if out:  # most calls only put rows into the state
            yield pd.DataFrame(out, columns=["asset_id", "ts", "_row", "_past", "place"])

    given = stream.where("asset_id IS NOT NULL AND timestamp IS NOT NULL").select(
        F.col("asset_id").cast("string").alias("asset_id"), "timestamp", F.unix_micros("timestamp").alias("ts"), F.to_json(F.struct(*cols)).alias("_row"))
    out = given.groupBy("asset_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("asset_id", F.timestamp_micros("ts").alias("timestamp"), F.from_json("_row", kept).alias("_r"),
                      F.from_json(F.concat(F.lit("["), F.array_join("_past", ","), F.lit("]")), T.ArrayType(kept)).alias("past"), "place").select("asset_id", "timestamp", "_r.*", "past", "place")


def batch_with_past(df: DataFrame, cols: Sequence[str], back: int) -> DataFrame:
    """The same columns for a table of bounded groups, by windows."""
    order = Window.partitionBy("asset_id").orderBy("timestamp")
    one = df.where("asset_id IS NOT NULL AND timestamp IS NOT NULL").groupBy("asset_id", "timestamp").agg(F.min(F.struct(*cols)).alias("_r"))
    past = F.collect_list("_r").over(order.rowsBetween(-back, -1))
    return one.withColumns({"past": past, "place": F.row_number().over(order).cast("long") - 1}).select("asset_id", "timestamp", "_r.*", "past", "place")


def _total(values: Column, fn: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + fn(v))


def expected_from_past(df: DataFrame, rows: int = 6) -> DataFrame:
    """Adds `expected`, the mean of `actual` over the rows before; null for an asset's first row."""
    before = F.transform(F.slice("past", F.greatest(F.size("past") - (rows - 1), F.lit(1)), F.lit(rows)), lambda r: r["actual"])
    return df.withColumn("expected", _total(before) / F.nullif(F.size(before).cast("double"), F.lit(0.0)))


def features_from_past(df: DataFrame, window: int = 16, skip_first: bool = True) -> DataFrame:
    """The detector features of tick_features and `seen`, from `past`; needs a look-back of `window` rows.

    skip_first: an asset's first row has no expectation, hence no features, and is not looked back on either.
    """
    first = (F.col("place") <= F.size("past")) if skip_first else F.lit(False)
    rows = df.withColumn("_v", F.when(first & (F.size("past") > 0), F.slice("past", F.lit(2), F.size("past"))).otherwise(F.col("past")))
    rows = rows.where("expected IS NOT NULL AND actual IS NOT NULL").withColumn("_v", F.transform("_v", lambda r: r["actual"]))
    last3 = F.concat(F.slice("_v", F.greatest(F.size("_v") - 1, F.lit(1)), F.lit(2)), F.array("actual"))
    prev = F.get("_v", F.size("_v") - 1)
    rows = rows.withColumns({"_l": last3, "rolling_mean": _total(last3) / F.size(last3)})
    spread = F.sqrt(_total(F.col("_l"), lambda v: (v - F.col("rolling_mean")) * (v - F.col("rolling_mean"))) / F.nullif(F.size("_l") - 1, F.lit(0)))
    return rows.withColumns({
        "dev_fraction": (F.col("actual") - F.col("expected")) / F.greatest(F.col("expected"), F.lit(1e-9)),
        "rolling_std": F.coalesce(spread, F.lit(0.0)),
        "change_rate": F.coalesce((F.col("actual") - prev) / F.nullif(prev, F.lit(0.0)), F.lit(0.0)),
        "seen": F.least(F.size("_v") + 1, F.lit(window)).cast("int")}).drop("_v", "_l")


def transitions_from_past(df: DataFrame) -> DataFrame:
    """The events of `transitions`, one row each; needs severity, priority, deviation_pct and a look-back of one row."""
    before = F.get("past", F.size("past") - 1)
    rows = df.withColumns({"_sev": F.coalesce(before["severity"], F.lit("NORMAL")), "_pri": F.coalesce(before["priority"], F.lit("LOW"))})
    return rows.select("asset_id", "timestamp", F.explode(events_of()).alias("e")).select("asset_id", "timestamp", "e.*")


def onsets_from_past(df: DataFrame) -> DataFrame:
    before = F.coalesce(F.get("past", F.size("past") - 1)["severity"], F.lit("NORMAL"))
    return df.where((before == "NORMAL") & (F.col("severity") != "NORMAL")).drop("past", "place")


LEVELS = ("severity", "priority", "deviation_pct")


def transition_stream(spark: SparkSession, scored: str, schema: T.StructType, lateness: str, **options: str) -> DataFrame:
    """Transitions of the scored readings that another query appends to a folder.

    Batches of that query follow each other in time. Read together, as they are without a limit of files, they need no
    lateness; where files are read apart (maxFilesPerTrigger), it covers the times that lie in one batch.
    """
    rows = spark.readStream.schema(schema).options(**options).parquet(scored)
    return transitions_from_past(with_past(with_lateness(rows, lateness), LEVELS, 1))


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet folder until the available input is used up; each row is stored once, also after a restart."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
