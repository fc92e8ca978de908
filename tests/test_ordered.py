"""Keyed state: streams of many micro-batches, with late rows, replays and a restart, equal the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldspark.streaming import ordered
from fieldspark.streaming import telemetry as st

DDL = "asset_id string, timestamp timestamp, actual double"
FIRST = datetime(2026, 1, 1)


def readings(n=100):
    rng = random.Random(9)
    return [(a, FIRST + timedelta(hours=3 * i, microseconds=7 * i), 100 * rng.choice([1, 1, 1, 0.6]) + rng.gauss(0, 8)) for i in range(n) for a in ("A", "B", "C")]


def scored(df):
    out = ordered.features_from_past(ordered.expected_from_past(df))
    out = st.score_ticks(out.withColumns({"raw_score": F.least(F.abs("change_rate"), F.lit(1.0)) * 0.9, "complexity": F.lit(0.5)}))
    return out.withColumn("deviation_pct", F.col("dev_fraction") * 100.0).select("asset_id", "timestamp", "severity", "priority", "deviation_pct", "anomaly_score", "score", "seen")


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def feed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path):
    """Both queries until their input is used up: readings to scores, scores to events."""
    source = st.telemetry_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], DDL).schema, maxFilesPerTrigger="1")
    stream = scored(ordered.with_past(st.with_lateness(source, "24 hours"), ["actual"], 16))
    ordered.append_stream(stream, str(tmp_path / "scored"), str(tmp_path / "cp1")).awaitTermination()
    events = ordered.transition_stream(spark, str(tmp_path / "scored"), stream.schema, "36 hours", maxFilesPerTrigger="1")
    ordered.append_stream(events, str(tmp_path / "events"), str(tmp_path / "cp2")).awaitTermination()


def test_stream_of_ten_batches_with_late_rows_and_a_restart_equals_batch(spark, tmp_path):
    data = readings()
    base = [data[30 * k : 30 * k + 30] for k in range(10)]
    # of each part some rows come one part later, within the bound, and some come again
    parts = [p[:-6] + p[-3:] + (base[k - 1][-6:-3] + base[k - 1][-12:-9] if k else []) for k, p in enumerate(base)] + [base[9][-6:-3]]
    feed(spark, tmp_path / "in", parts[:6])
    run(spark, tmp_path)
    feed(spark, tmp_path / "in", parts[6:])
    run(spark, tmp_path)  # new queries over the checkpoints of the first
    whole = spark.createDataFrame(data, DDL)
    mark = max(r[1] for r in data).replace(microsecond=0) - timedelta(hours=24)  # watermarks are whole milliseconds
    want = scored(ordered.batch_with_past(whole, ["actual"], 16)).where(F.col("timestamp") <= F.lit(mark))
    got = spark.read.parquet(str(tmp_path / "scored"))
    assert rows_of(got) == rows_of(want) and got.count() > 250
    events = spark.read.parquet(str(tmp_path / "events"))
    mark = got.agg(F.max("timestamp")).first()[0].replace(microsecond=0) - timedelta(hours=36)
    assert rows_of(events) == rows_of(st.transitions(want).where(F.col("timestamp") <= F.lit(mark))) and events.count() > 100
    assert rows_of(ordered.transitions_from_past(ordered.batch_with_past(want, ordered.LEVELS, 1))) == rows_of(st.transitions(want))
    past = ordered.batch_with_past(want, ordered.LEVELS, 1)
    assert rows_of(ordered.onsets_from_past(past).select("asset_id", "timestamp", "severity")) == rows_of(st.onsets(want).select("asset_id", "timestamp", "severity"))


def test_array_features_equal_the_windows(spark):
    whole = spark.createDataFrame(readings(60), DDL)
    mine = ordered.features_from_past(ordered.expected_from_past(ordered.batch_with_past(whole, ["actual"], 16)))
    plain = st.over_slices(whole, ["asset_id"], ["timestamp"], lambda w: {"expected": F.avg("actual").over(w.rowsBetween(-6, -1))}, 6, "timestamp", "day")
    cols = ["asset_id", "timestamp", "expected", "dev_fraction", "rolling_mean", "rolling_std", "change_rate", "seen"]
    for a, b in zip(rows_of(mine.select(cols)), rows_of(st.tick_features(plain).select(cols)), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-6, abs=1e-6)


class State:
    """A group's state without Spark."""

    def __init__(self):
        self.value, self.mark, self.hasTimedOut, self.timeout = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.mark

    def setTimeoutTimestamp(self, ms):  # noqa: N802
        assert ms > self.mark
        self.timeout = ms


def test_state_is_bounded_and_keys_pass_once(spark, monkeypatch):
    import pandas as pd
    from pyspark.sql import GroupedData

    taken = []
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, fn, out, *a: taken.append(fn) or spark.createDataFrame([], out))
    ordered.with_past(spark.createDataFrame([], DDL), ["actual"], 4)
    step, state, out = taken[0], State(), []
    r = random.Random(3)
    for k in range(200):
        state.mark = max(0, 1000 * (k - 5))
        new = [1_000_000 * (k - r.randrange(5)) for _ in range(3)] + [1_000_000 * k]
        new = [ts for ts in new if ts > state.mark * 1000]  # what Spark lets through
        for frame in step(("A",), iter([pd.DataFrame({"ts": new, "_row": [str(ts) for ts in new]})]), state):
            out += frame.itertuples(index=False)
        assert len(state.value[2]) <= 4 + 6
    times = [x.ts for x in out]
    assert times == sorted(set(times)) and len(times) > 190 and [x.place for x in out] == list(range(len(out)))
    assert [x[3] for x in out][-1] == [str(ts) for ts in times[-5:-1]]


def test_rows_before_are_read_in_one_go(spark):
    """The texts of a reading's look-back are read as one JSON array, not one by one."""
    stream = spark.readStream.format("rate").load().selectExpr("'A' AS asset_id", "timestamp", "CAST(value AS DOUBLE) AS actual").withWatermark("timestamp", "1 hour")
    out = ordered.with_past(stream, ["actual"], 16)
    assert "transform(" not in out._jdf.queryExecution().analyzed().toString()
    assert dict(out.dtypes)["past"] == "array<struct<actual:double>>"
