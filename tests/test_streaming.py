import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldspark.config import StreamConfig
from fieldspark.streaming import telemetry as st


def readings(n=120):
    rng = random.Random(9)
    first = datetime(2026, 1, 1)
    return [(a, first + timedelta(hours=3 * i), 100 + rng.gauss(0, 15), 100.0) for i in range(n) for a in ("A", "B")]


DDL = "asset_id string, timestamp timestamp, actual double, expected double"


def ticks(df, unit="day"):
    feats = st.tick_features(df, unit)
    return st.score_ticks(feats.withColumns({"raw_score": F.least(F.abs("change_rate"), F.lit(1.0)), "complexity": F.lit(0.4)}))


def _rows(df):
    return sorted((r.asset_id, r.timestamp, round(r.anomaly_score, 9), r.severity, r.priority, r.seen) for r in df.collect())


def test_stream_over_many_batches_equals_batch(spark, tmp_path):
    data = readings()
    for k in range(4):  # four files, one micro-batch each; the last repeats rows of the third
        part = data[k * 60:(k + 1) * 60] + (data[150:170] if k == 3 else [])
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = st.telemetry_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], DDL).schema, maxFilesPerTrigger="1")
    stream = st.dedupe_stream(st.with_lateness(source, "1 hour"))
    run = st.write_observations(stream, str(tmp_path / "table"), str(tmp_path / "cp"), ticks, config=StreamConfig(keep=64))
    run.awaitTermination()
    assert _rows(st.read_observations(spark, str(tmp_path / "table"))) == _rows(ticks(spark.createDataFrame(data, DDL)))


def test_history_seeds_the_buffer(spark, tmp_path):
    data = readings(20)
    spark.createDataFrame(data[28:], DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = st.telemetry_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], DDL).schema)
    st.write_observations(source, str(tmp_path / "table"), str(tmp_path / "cp"), ticks, spark.createDataFrame(data[:28], DDL)).awaitTermination()
    got = _rows(st.read_observations(spark, str(tmp_path / "table")))
    want = [r for r in _rows(ticks(spark.createDataFrame(data, DDL))) if r[1] >= data[28][1]]
    assert got == want and min(r[5] for r in got) >= 6


def test_scores_stay_zero_before_the_buffer_fills(spark):
    rows = _rows(ticks(spark.createDataFrame(readings(10), DDL)))
    assert all(r[2] == 0.0 for r in rows if r[5] < 6) and any(r[5] >= 6 for r in rows)


def test_transitions_and_onsets(spark):
    first = datetime(2026, 1, 1)
    seq = [("NORMAL", "LOW", 0.0), ("NORMAL", "LOW", -12.0), ("ALERT", "LOW", -15.0), ("ALERT", "HIGH", -15.0), ("NORMAL", "LOW", -1.0), ("WATCH", "LOW", -9.0)]
    df = spark.createDataFrame([("A", first + timedelta(days=i), *s) for i, s in enumerate(seq)],
                               "asset_id string, timestamp timestamp, severity string, priority string, deviation_pct double")
    ev = [(r.timestamp.day, r.category, r.label) for r in st.transitions(df).orderBy("timestamp", "category").collect()]
    assert ev == [(2, "DEVIATION", "BELOW_EXPECTATION"), (3, "ANOMALY", "ALERT"), (4, "PRIORITY", "HIGH"), (5, "ANOMALY", "NORMAL"),
                  (5, "PRIORITY", "LOW"), (6, "ANOMALY", "WATCH")]
    assert [r.timestamp.day for r in st.onsets(df).orderBy("timestamp").collect()] == [3, 6]


def test_replays_and_late_rows_over_batches(spark, tmp_path):
    data = [r for r in readings(120) if r[0] == "A"]
    late = [data[3], data[95]]  # one far behind the kept rows, one among them
    rest = [r for r in data if r not in late]
    parts = [rest[:80], rest[80:110], rest[110:] + late + [rest[0], rest[5], rest[100]]]
    for part in parts:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = st.telemetry_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], DDL).schema, maxFilesPerTrigger="1")
    st.write_observations(source, str(tmp_path / "table"), str(tmp_path / "cp"), ticks, config=StreamConfig(keep=64)).awaitTermination()
    got = _rows(st.read_observations(spark, str(tmp_path / "table")))
    assert [r.timestamp for r in st.late_observations(spark, str(tmp_path / "table")).collect()] == [late[0][1]]
    assert sorted(r[1] for r in got) == sorted(r[1] for r in data if r != late[0])  # every other key once
    whole = {r[1]: r for r in _rows(ticks(spark.createDataFrame(data, DDL)))}
    assert whole[late[1][1]] in got  # scored as if it had come in time


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    data = readings(40)
    spark.createDataFrame(data, DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = st.telemetry_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], DDL).schema)
    for attempt in ("one", "two"):  # a second checkpoint makes batch 0 run again over the same table
        st.write_observations(source, str(tmp_path / "table"), str(tmp_path / attempt), ticks).awaitTermination()
    assert _rows(st.read_observations(spark, str(tmp_path / "table"))) == _rows(ticks(spark.createDataFrame(data, DDL)))


def _source(spark, tmp_path, name="in"):
    return st.telemetry_stream(spark, str(tmp_path / name), spark.createDataFrame([], DDL).schema, maxFilesPerTrigger="1")


def _fails_on(bad):
    def transform(df):
        return ticks(df).withColumn("checked", F.when(F.col("_new") & (F.col("actual") == bad), F.raise_error(F.lit("no such value"))).otherwise(F.lit(1)))
    return transform


def test_a_failing_batch_is_set_aside_and_the_stream_goes_on(spark, tmp_path):
    data, place = [r for r in readings(60) if r[0] == "A"], str(tmp_path / "table")
    poison = ("A", data[-1][1] + timedelta(hours=3), -999.0, 100.0)
    for part in (data[:20], data[20:40] + [poison], data[40:]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    st.write_observations(_source(spark, tmp_path), place, str(tmp_path / "cp"), _fails_on(-999.0), on_error="set_aside").awaitTermination()
    log = {r.batch_id: r for r in st.batch_log(spark, place).collect()}
    assert [log[i].status for i in range(3)] == ["stored", "set_aside", "stored"] and "no such value" in log[1].error
    assert [log[i].rows for i in range(3)] == [20, 0, 20]
    aside = st.aside_observations(spark, place)
    assert sorted(r.timestamp for r in aside.collect()) == sorted(r[1] for r in data[20:40] + [poison])
    assert sorted(r.timestamp for r in st.read_observations(spark, place).collect()) == [r[1] for r in data[:20] + data[40:]]
    # the rows kept before the failed batch still score the one after it
    want = {r[1]: r for r in _rows(ticks(spark.createDataFrame(data[:20] + data[40:], DDL)))}
    assert _rows(st.read_observations(spark, place)) == sorted(want.values())
    # mended rows stream again: none of their keys counts as stored
    aside.where("actual <> -999.0").select("asset_id", "timestamp", "actual", "expected").coalesce(1).write.parquet(str(tmp_path / "in2"))
    for f in (tmp_path / "in2").glob("part-*"):
        (tmp_path / "in" / ("again-" + f.name)).write_bytes(f.read_bytes())
    st.write_observations(_source(spark, tmp_path), place, str(tmp_path / "cp"), _fails_on(-999.0), config=StreamConfig(keep=64), on_error="set_aside").awaitTermination()
    stored = [r.timestamp for r in st.read_observations(spark, place).collect()] + [r.timestamp for r in st.late_observations(spark, place).collect()]
    assert sorted(stored) == [r[1] for r in data]


def test_a_failing_batch_stops_the_stream_by_default(spark, tmp_path):
    spark.createDataFrame([("A", datetime(2026, 1, 1), -999.0, 1.0)], DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = st.write_observations(_source(spark, tmp_path), str(tmp_path / "table"), str(tmp_path / "cp"), _fails_on(-999.0))
    with pytest.raises(Exception, match="no such value"):
        run.awaitTermination()


def test_compaction_between_runs_changes_no_row(spark, tmp_path):
    data, place = [r for r in readings(100) if r[0] == "A"], str(tmp_path / "table")
    add = lambda part: spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda cp="cp": st.write_observations(_source(spark, tmp_path), place, str(tmp_path / cp), ticks, config=StreamConfig(keep=64)).awaitTermination()
    whole = lambda n: _rows(ticks(spark.createDataFrame(data[:n], DDL)))
    for part in (data[:30], data[30:50]):
        add(part)
    run()
    st.compact_observations(spark, place)
    assert _rows(st.read_observations(spark, place)) == whole(50)
    assert not list((tmp_path / "table" / "out").glob("batch_id=*")) and not list((tmp_path / "table" / "rows").glob("batch_id=*"))
    add(data[40:80])  # ten replays of merged rows among them
    run()
    assert _rows(st.read_observations(spark, place)) == whole(80)
    st.compact_observations(spark, place)
    add(data[80:])
    run()
    assert _rows(st.read_observations(spark, place)) == whole(100)
    run("other")  # everything again under new batch numbers: nothing is stored twice
    assert sorted(r[1] for r in _rows(st.read_observations(spark, place))) == [r[1] for r in data]
