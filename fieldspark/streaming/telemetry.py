"""Live telemetry: the batch operators on micro-batches.

Row-level logic (dedupe, windows, scoring columns) is shared with the batch side. Features that look back run in
foreachBatch over the batch plus the stored last rows per asset, with the time-sliced windows of the batch operators, so a
very active asset spreads over tasks and no Python state is kept. Every micro-batch writes under its own id: a retry
overwrites what the failed attempt left, and only batches with smaller ids are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldspark.config import ScoreConfig, StreamConfig
from fieldspark.functions.columns import deviation_fraction, severity
from fieldspark.operators import scoring
from fieldspark.operators.clean import dedupe
from fieldspark.operators.features import anomaly_features
from fieldspark.operators.sliced import over_slices
from fieldspark.sources.sinks import read_table


def telemetry_stream(spark: SparkSession, path: str | None = None, schema: T.StructType | None = None, fmt: str = "parquet",
                     time_col: str = "timestamp", **options: str) -> DataFrame:
    """File stream with a fixed schema, or any other streaming source (kafka, rate, ...); the time column is a zoned timestamp."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    out = reader.load(path) if path is not None else reader.load()
    return out.withColumn(time_col, F.col(time_col).cast("timestamp")) if time_col in out.columns else out


def with_lateness(df: DataFrame, delay: str = "1 hour", time_col: str = "timestamp") -> DataFrame:
    return df.withWatermark(time_col, delay)


def dedupe_stream(df: DataFrame, keys: tuple[str, ...] = ("asset_id", "timestamp")) -> DataFrame:
    """First row per key; state is dropped once the watermark has passed."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def window_agg(df: DataFrame, width: str, slide: str | None = None, by: tuple[str, ...] = ("asset_id",),
               value: str = "production") -> DataFrame:
    """Tumbling or sliding averages; the same call serves batch and stream."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    out = df.groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("readings"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "readings", "mean", "lo", "hi")


def session_agg(df: DataFrame, gap: str, by: tuple[str, ...] = ("asset_id",), value: str = "production") -> DataFrame:
    out = df.groupBy(F.session_window("timestamp", gap).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("readings"), F.avg(value).alias("mean"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "readings", "mean")


def tick_score(raw_score: Column, dev_fraction: Column) -> Column:
    """Forest score, raised by the deviation rule only where the rule alone reaches 0.5."""
    rule = F.least(F.abs(dev_fraction) * 5.0, F.lit(1.0))
    return F.least(F.greatest(F.when(rule >= 0.5, F.greatest(raw_score, rule)).otherwise(raw_score), F.lit(0.0)), F.lit(1.0))


def score_ticks(df: DataFrame, config: ScoreConfig = ScoreConfig(), stream: StreamConfig = StreamConfig()) -> DataFrame:
    """Rows with actual, expected, raw_score, seen (buffered readings) and complexity -> severity, recovery and priority.

    Column expressions only, so batch and stream give the same result. With fewer buffered rows than the minimum the
    anomaly score stays zero.
    """
    held = df.withColumn("dev_fraction", deviation_fraction(F.col("actual"), F.col("expected")))
    ready = F.col("seen") >= stream.min_rows
    held = held.withColumn("anomaly_score", F.when(ready, tick_score(F.col("raw_score"), F.col("dev_fraction"))).otherwise(0.0))
    held = held.withColumn("severity", severity(F.col("anomaly_score"))).drop("raw_score")
    return scoring.priority_score(scoring.recovery(held, config), config).withColumnRenamed("raw_score", "weighted_score")


def attach_forecast(ticks: DataFrame, points: DataFrame, step: int = 1) -> DataFrame:
    """Adds the stored forecast of the coming month; a stream-static join on the asset."""
    return ticks.join(points.where(F.col("step") == step).select("asset_id", F.col("forecast").alias("forecast_30d")), "asset_id", "left")


def tick_features(df: DataFrame, slice_unit: str | None = "day", window: int = 16) -> DataFrame:
    """Detector features per reading and `seen`, the number of buffered readings up to `window`."""
    def seen(w) -> dict[str, Column]:
        return {"seen": F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), 0)).cast("int")}

    return anomaly_features(df, "timestamp", slice_unit=slice_unit, more=seen, back=window - 1)


def _last_rows(df: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("asset_id").orderBy(F.col("timestamp").desc())
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def _too_late(rows: DataFrame, tail: DataFrame, config: StreamConfig) -> DataFrame:
    """Adds `_late`: too few kept rows lie before the reading to score it as it should be.

    Only an asset whose tail is full can have rows that are kept no more; a tail has at most `config.keep` rows.
    """
    known = tail.groupBy("asset_id").agg(F.sort_array(F.collect_list("timestamp")).alias("_known"))
    full = F.size("_known") >= config.keep
    joined = rows.join(known, "asset_id", "left")
    return joined.withColumn("_late", F.coalesce(full & (F.col("timestamp") <= F.get("_known", F.lit(config.look_back - 1))), F.lit(False))).drop("_known")


def write_observations(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                       history: DataFrame | None = None, config: StreamConfig = StreamConfig(), order: Sequence[str] = (),
                       on_error: str = "stop", attempts: int = 2) -> StreamingQuery:
    """Append scored observations, one folder per micro-batch, until the available input is used up.

    `transform` maps (kept rows + new rows) to output rows keyed by (asset_id, timestamp); only those of the new rows are
    written. Every key is stored once, whatever the age of a replay: new rows are anti-joined with the stored keys of their
    days. Of rows with one key inside a batch the first in `order` stays (default: all columns), so a retry picks the same.
    A late reading is scored with the kept rows before it; if those are fewer than `config.look_back` of a longer history, it
    goes unscored to the table of `late_observations`. Rows that were written before it are not scored again.

    The last `config.keep` rows per asset, seeded with `history`, are kept in two folders that take turns. Writing a batch
    again replaces it, so a retry leaves no duplicates. A batch ends with its record in `batch_log`; readers see only batches
    that have one. With `on_error` "set_aside" a batch that fails `attempts` times goes whole to `aside_observations` with the
    error, none of its keys count as stored, and the stream goes on; "stop" ends the stream with the error. Between runs
    `compact_observations` merges the folders of the batches.
    """
    if on_error not in ("stop", "set_aside"):
        raise ValueError("on_error must be 'stop' or 'set_aside'")
    spark, root = df.sparkSession, path.rstrip("/")
    order = list(order) or sorted(df.columns)
    stored = T.StructType([*df.schema.fields, T.StructField("_late", T.BooleanType()), T.StructField("batch_id", T.LongType()),
                           T.StructField("day", T.DateType())])
    in_folder = T.StructType([f for f in stored.fields if f.name != "batch_id"])
    spark.createDataFrame([], stored).write.mode("ignore").partitionBy("batch_id", "day").parquet(f"{root}/rows")
    merged = _generation(spark, root)

    def tail_before(session: SparkSession, batch_id: int, schema: T.StructType) -> DataFrame:
        if batch_id > 0:
            return session.read.schema(schema).parquet(f"{root}/tail/{(batch_id - 1) % 2}")
        return _last_rows(history.select(*schema.names), config.keep) if history is not None else session.createDataFrame([], schema)

    def store(session: SparkSession, fresh: DataFrame, batch_id: int, schema: T.StructType) -> tuple[int, int]:
        keys, tail = ["asset_id", "timestamp"], tail_before(session, batch_id, schema)
        days = fresh.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
        if days["first"] is None:  # a batch without rows only hands the tail on
            tail.write.mode("overwrite").parquet(f"{root}/tail/{batch_id % 2}")
            return 0, 0
        span = F.col("day").between(days["first"], days["last"])
        past = session.read.schema(stored).parquet(f"{root}/rows").where((F.col("batch_id") < batch_id) & (F.col("batch_id") > merged.through))
        fresh = fresh.join(past.where(span).select(*keys), keys, "left_anti")
        if merged.number:
            done = session.read.schema(in_folder).parquet(f"{root}/merged/rows/{merged.number % 2}")
            fresh = fresh.join(done.where(span).select(*keys), keys, "left_anti")
        if history is not None:
            at = F.col("timestamp")
            near = (at >= F.lit(days["first"]).cast("timestamp")) & (at < F.date_add(F.lit(days["last"]), 1).cast("timestamp"))
            fresh = fresh.join(history.where(near).select(*keys), keys, "left_anti")
        here = f"{root}/rows/batch_id={batch_id}"
        _too_late(fresh, tail, config).select(*schema.names, "_late", "day").hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(here)
        written = session.read.schema(in_folder).parquet(here)
        new = written.where(~F.col("_late"))
        both = new.select(*schema.names, F.lit(True).alias("_new")).unionByName(tail.withColumn("_new", F.lit(False)))
        out = transform(both) if transform else both
        out.where(F.col("_new")).drop("_new").write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")
        _last_rows(both.drop("_new"), config.keep).write.mode("overwrite").parquet(f"{root}/tail/{batch_id % 2}")
        n = written.agg(F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late")).first()
        return n["rows"], n["late"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # the source and its state are read once; everything after starts from the written batch
        first = dedupe(batch, order, "first", ["asset_id", "timestamp"]).withColumn("day", F.to_date("timestamp"))
        first.write.mode("overwrite").parquet(f"{root}/incoming/{batch_id % 2}")
        fresh = session.read.schema(first.schema).parquet(f"{root}/incoming/{batch_id % 2}")
        error, counts = None, (0, 0)
        for _ in range(attempts):
            try:
                error, counts = None, store(session, fresh, batch_id, batch.schema)
                break
            except Exception as e:  # whatever the transform raises
                if on_error == "stop":
                    raise
                error = f"{type(e).__name__}: {e}"[:2000]
        if error is not None:
            fresh.drop("day").withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{root}/aside/batch_id={batch_id}")
            session.createDataFrame([], in_folder).write.mode("overwrite").partitionBy("day").parquet(f"{root}/rows/batch_id={batch_id}")
            tail_before(session, batch_id, batch.schema).write.mode("overwrite").parquet(f"{root}/tail/{batch_id % 2}")
        record = ("stored" if error is None else "set_aside", *counts, error)
        session.createDataFrame([record], LOG).coalesce(1).write.mode("overwrite").parquet(f"{root}/log/batch_id={batch_id}")

    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LOG = "status string, rows bigint, late bigint, error string"


@dataclass(frozen=True)
class Generation:
    """The merged tables in use: their number (0: none) and the last batch in them whose folder may still be there."""

    number: int = 0
    through: int = -1


def _generation(spark: SparkSession, root: str) -> Generation:
    records = read_table(spark, f"{root}/merged/generations")
    last = records.orderBy(F.desc("number"), F.desc("cleared")).first() if records is not None else None
    return Generation() if last is None else Generation(last["number"], -1 if last["cleared"] else last["through"])


def _batches(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The rows of batches that ended, without those in the merged tables."""
    rows = read_table(spark, f"{root}/{table}")
    if rows is None or "batch_id" not in rows.columns:
        return None
    ended = spark.read.parquet(f"{root}/log").where((F.col("status") == "stored") & (F.col("batch_id") > _generation(spark, root).through))
    return rows.join(ended.select("batch_id"), "batch_id", "left_semi").drop("batch_id")


def _whole(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Merged rows and those of the batches since."""
    now = _generation(spark, root)
    parts = [read_table(spark, f"{root}/merged/{table}/{now.number % 2}") if now.number else None, _batches(spark, root, table)]
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b.select(*a.columns)), parts) if parts else None


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    out = _whole(spark, path.rstrip("/"), "out")
    if out is None:
        raise FileNotFoundError(f"no observations under {path}")
    return out


def late_observations(spark: SparkSession, path: str) -> DataFrame:
    """The stored readings that came too late to be scored."""
    return _whole(spark, path.rstrip("/"), "rows").where("_late").drop("_late", "day")


def aside_observations(spark: SparkSession, path: str) -> DataFrame | None:
    """The readings of failed batches with `batch_id` and `error`, or None. None of their keys is stored, so they can be streamed again."""
    return read_table(spark, f"{path.rstrip('/')}/aside")


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per ended batch: batch_id, status (stored, set_aside), rows, late ones among them, error."""
    return spark.read.parquet(f"{path.rstrip('/')}/log").select("batch_id", *[c.split()[0] for c in LOG.split(", ")])


def compact_observations(spark: SparkSession, path: str) -> None:
    """Merges the folders of all ended batches into tables by day; not while a stream writes.

    Two places take turns. The new tables count from the record that is written after them, and the folders of the batches go
    after that record, so a run that is cut short at any point loses and doubles nothing. The log keeps every record.
    """
    root = path.rstrip("/")
    now = _generation(spark, root)
    out, rows = _whole(spark, root, "out"), _whole(spark, root, "rows")
    ended = spark.read.parquet(f"{root}/log").agg(F.max("batch_id")).first()[0]
    if out is None or rows is None or ended is None:
        return
    number = now.number + 1
    out.withColumn("_day", F.to_date("timestamp")).hint("rebalance", "_day").drop("_day").write.mode("overwrite").parquet(f"{root}/merged/out/{number % 2}")
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{root}/merged/rows/{number % 2}")

    def record(cleared: bool) -> None:
        spark.createDataFrame([(number, ended, cleared)], "number bigint, through bigint, cleared boolean").coalesce(1).write.mode(
            "append").parquet(f"{root}/merged/generations")

    record(False)
    for table in ("out", "rows"):
        read = read_table(spark, f"{root}/{table}")
        if read is not None:
            spark.createDataFrame([], read.schema).write.mode("overwrite").parquet(f"{root}/{table}")
    record(True)


def transitions(df: DataFrame, slice_unit: str | None = "day") -> DataFrame:
    """Severity changes, deviations below -10 % while NORMAL, and priority changes, one row per event.

    Needs asset_id, timestamp, severity, priority, deviation_pct. Before its first row an asset counts as NORMAL / LOW.
    """
    rows = over_slices(
        df, ["asset_id"], ["timestamp"],
        lambda w: {"_sev": F.lag("severity", 1, "NORMAL").over(w), "_pri": F.lag("priority", 1, "LOW").over(w)},
        1, "timestamp", slice_unit)
    return rows.select("asset_id", "timestamp", F.explode(events_of()).alias("e")).select("asset_id", "timestamp", "e.*")


def events_of() -> Column:
    """The events of a row (array of category, label, level); _sev and _pri are the levels of the row before."""
    moved = F.col("severity") != F.col("_sev")

    def event(cond: Column, category: str, label: Column, level: Column) -> Column:
        return F.when(cond, F.struct(F.lit(category).alias("category"), label.alias("label"), level.alias("level")))

    return F.array_compact(F.array(
        event(moved, "ANOMALY", F.col("severity"), F.col("severity")),
        event(~moved & (F.col("severity") == "NORMAL") & (F.col("deviation_pct") < -10), "DEVIATION", F.lit("BELOW_EXPECTATION"), F.lit("WATCH")),
        event(F.col("priority") != F.col("_pri"), "PRIORITY", F.col("priority"), F.col("severity"))))


def onsets(df: DataFrame, slice_unit: str | None = "day") -> DataFrame:
    """Rows where an asset leaves NORMAL."""
    rows = over_slices(df, ["asset_id"], ["timestamp"], lambda w: {"_sev": F.lag("severity", 1, "NORMAL").over(w)}, 1,
                       "timestamp", slice_unit)
    return rows.where((F.col("_sev") == "NORMAL") & (F.col("severity") != "NORMAL")).drop("_sev")


def latest_n(df: DataFrame, n: int = 200) -> DataFrame:
    """The newest n rows per asset; the limit is applied in the map tasks."""
    return _last_rows(df, n)


def stream_summary(df: DataFrame) -> DataFrame:
    """Readings and the newest scores per asset."""
    last = F.max(F.struct("timestamp", "anomaly_score", "severity", "score", "priority"))
    return df.groupBy("asset_id").agg(F.count(F.lit(1)).alias("ticks"), last.alias("l")).select(
        "asset_id", "ticks", F.col("l.timestamp").alias("last_timestamp"), "l.anomaly_score", "l.severity", "l.score", "l.priority")
