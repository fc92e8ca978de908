import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fieldspark.config import CleanConfig
from fieldspark.operators import clean
from fieldspark.plans.ingest import IngestError, ingest, ingest_synthetic
from fieldspark.schema import ANOMALY_RULES
from fieldspark.sources import mapping, readers, sinks
from tests.conftest import TELEMETRY_DDL, daily


@pytest.mark.parametrize("raw, want", [
    ("Oil Rate (bbl/d)", "oil_rate_bbl_d"), ("  Well-Code ", "well_code"), ("A__B", "a_b"), ("_x_", "x"), ("Temp °C", "temp_c")])
def test_normalize_header(raw, want):
    assert mapping.normalize_header(raw) == want


def test_resolve_columns_aliases_and_explicit_map():
    cols = ["Well Code", "Reporting Date", "Oil Rate (bbl/d)", "Note"]
    found = mapping.resolve_columns(cols)
    assert found == {"asset_id": "Well Code", "timestamp": "Reporting Date", "production": "Oil Rate (bbl/d)"}
    assert mapping.unmapped_columns(cols, found) == ["Note"]
    explicit = {"asset_id": "Well Identifier", "timestamp": "Report Date", "production": "Crude Rate"}
    assert mapping.resolve_columns(list(explicit.values()), explicit) == explicit


@pytest.mark.parametrize("cols, cmap", [
    (["asset", "date"], None), (["asset", "date", "oil_rate"], {"colour": "asset"}), (["asset", "date", "oil_rate"], {"asset_id": "absent"})])
def test_resolve_columns_errors(cols, cmap):
    with pytest.raises(mapping.MappingError):
        mapping.resolve_columns(cols, cmap)


def test_mapping_keeps_nulls_and_utc(spark):
    df = spark.createDataFrame([(" A ", "2026-01-01T00:00:00Z", "120.5"), ("B", "bad", "x")], "asset_id string, timestamp string, production string")
    rows = {r.asset_id: r for r in mapping.to_telemetry(df, source_type="REAL").collect()}
    assert rows["A"].production == 120.5 and rows["A"].pressure is None and rows["A"].source_type == "REAL"
    assert rows["B"].timestamp is None and rows["B"].production is None


@pytest.mark.parametrize("values, default", [(["REAL", "SYNTHETIC"], None), (["GUESS", "GUESS"], None), ([None, None], None), ([None, None], "other")])
def test_provenance_gate_rejects(spark, values, default):
    df = spark.createDataFrame([("A", v) for v in values], "asset_id string, source_type string")
    with pytest.raises(mapping.MappingError):
        mapping.resolve_source_type(df, default)


def test_provenance_gate_accepts(spark):
    df = spark.createDataFrame([("A", "REAL"), ("A", None)], "asset_id string, source_type string")
    assert mapping.resolve_source_type(df, "SYNTHETIC") == "REAL"
    assert mapping.resolve_source_type(df.where(F.col("source_type").isNull()), "derived") == "DERIVED"


@pytest.mark.parametrize("payload, lines", [
    ({"records": [{"asset_id": "A", "date": "2026-01-01", "oil_bbl_d": 1.5}, {"asset_id": "B", "date": "2026-01-02", "oil_bbl_d": 2.5}]}, None),
    ({"items": [{"asset_id": "A", "date": "2026-01-01", "oil_bbl_d": 1.5}, {"asset_id": "B", "date": "2026-01-02", "oil_bbl_d": 2.5}]}, None),
    ([{"asset_id": "A", "date": "2026-01-01", "oil_bbl_d": 1.5}, {"asset_id": "B", "date": "2026-01-02", "oil_bbl_d": 2.5}], None),
    ("lines", True)])
def test_read_json_layouts(spark, tmp_path, payload, lines):
    rows = [{"asset_id": "A", "date": "2026-01-01", "oil_bbl_d": 1.5}, {"asset_id": "B", "date": "2026-01-02", "oil_bbl_d": 2.5}]
    text = "\n".join(json.dumps(r) for r in rows) if payload == "lines" else json.dumps(payload)
    (tmp_path / "in.json").write_text(text)
    out = mapping.to_telemetry(readers.read_json(spark, str(tmp_path / "in.json"), lines=lines), source_type="REAL")
    assert sorted((r.asset_id, r.production) for r in out.collect()) == [("A", 1.5), ("B", 2.5)]


def test_read_csv_and_public_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Well Code;Reporting Date;Oil Rate (bbl/d)\nA;2026-01-01;3.5\nA;2026-02-01;\n")
    out = mapping.to_telemetry(readers.read_csv(spark, str(tmp_path / "in.csv"), sep=";"), source_type="REAL").collect()
    assert [r.production for r in out] == [3.5, None]
    tagged = readers.load_public_csv(spark, str(tmp_path / "in.csv"), sep=";")
    assert {r.source_type for r in tagged.collect()} == {"REAL"}


def test_observed_load_counts_without_second_pass(spark):
    df, seen = readers.observed_load(spark.createDataFrame(daily(5), TELEMETRY_DDL))
    df.count()
    assert seen.get["rows"] == 5 and seen.get["synthetic_rows"] == 5


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame(daily(40) + daily(3), TELEMETRY_DDL).withColumn("n", F.lit(1))
    path = str(tmp_path / "t")
    sinks.append_new(df, path, order=("n",))
    sinks.append_new(df, path, order=("n",))
    sinks.append_new(spark.createDataFrame(daily(45), TELEMETRY_DDL).withColumn("n", F.lit(1)), path, order=("n",))
    assert spark.read.parquet(path).count() == 45


def test_append_prunes_to_the_months_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.append_new(spark.createDataFrame(daily(800, start="2024-01-01"), TELEMETRY_DDL), path) == 800
    late = daily(2, start="2024-02-03") + daily(3, start="2026-05-01") + [("A-9", daily(1, start="2024-02-03")[0][1], 1.0, "feed", "REAL")]
    batch = spark.createDataFrame(late, TELEMETRY_DDL)
    assert sinks.append_new(batch, path) == 4 and sinks.append_new(batch, path) == 0
    assert spark.read.parquet(path).count() == 804


def test_facts_that_break_their_contract_are_set_aside(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0.5, "WATCH", "OPEN"), ("B", 1.5, "WATCH", None), ("C", None, "LOUD", None)],
                                 "asset_id string, anomaly_score double, severity string, status string").withColumn("status", F.lit(None).cast("string"))
    counts = sinks.write_facts(rows, ANOMALY_RULES, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counts == {"stored": 1, "rejected": 2}
    assert {r.asset_id: r.reasons for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"B": ["score_out_of_range"], "C": ["severity_invalid"]}


def test_ingest_reports_every_step_and_repeats_safely(spark, tmp_path):
    at = daily(60)[0][1]
    rows = [(*r[:2], r[2] + i % 3, *r[3:], 50.0) for i, r in enumerate(daily(60))] + [
        (None, None, 1.0, "f", "SYNTHETIC", 1.0), ("A-1", at, -4.0, "f", "SYNTHETIC", 1.0), ("A-1", at, 101.0, "f", "SYNTHETIC", 40.0),
        ("N-1", at, 5.0, "f", "SYNTHETIC", 9000.0), ("N-1", at, 5.0, "f", "SYNTHETIC", None), ("N-1", at + timedelta(days=2), 5.0, "f", "SYNTHETIC", 8.0)]
    rows[55] = (*rows[55][:2], rows[55][2] + 900, *rows[55][3:])
    df = spark.createDataFrame(rows, TELEMETRY_DDL + ", pressure double").withColumn("n", F.monotonically_increasing_id())
    assets, place = spark.createDataFrame([("A-1",)], "asset_id string"), str(tmp_path / "history")
    done = ingest(df, place, assets, ("n",), CleanConfig(impute=True), mapped=True)
    want = {"rows_received": 66, "missing_required_dropped": 1, "negative_dropped": 1, "unit_rows_dropped": 1, "pressure_violations": 1, "duplicates_removed": 1,
            "pressure_imputed": 1, "outliers_removed": 1, "output_rows": 61, "rows_persisted": 61, "rows_skipped_stored": 0, "assets_created": 1, "missing_pressure": 0}
    assert {k: done.figures[k] for k in want} == want
    assert done.issues == {"unit_violations": 1, "outliers_removed": 1}
    assert [(r.asset_id, r.status) for r in done.assets.collect()] == [("N-1", "REGISTERED")]
    assert [(r.dataset_name, r.source_type) for r in done.source.collect()] == [("dataset", "SYNTHETIC")]
    again = ingest(df, place, assets, ("n",), CleanConfig(impute=True), mapped=True, create_assets=False)
    assert again.figures["rows_persisted"] == 0 and again.issues["unknown_assets_skipped"] == 2 and again.assets.count() == 0
    assert again.figures["rows_skipped_stored"] == 59 and spark.read.parquet(place).count() == 61
    assert again.report().first()["issues"]["unknown_assets_skipped"] == 2


def test_ingest_of_nothing_is_an_error_and_of_bad_rows_an_issue(spark, tmp_path):
    df = spark.createDataFrame([("A-1", None, -1.0, "f", "REAL")], TELEMETRY_DDL)
    assets = spark.createDataFrame([("A-1",)], "asset_id string")
    for call in (ingest, ingest_synthetic):
        with pytest.raises(IngestError):
            call(df.limit(0), str(tmp_path / "h"), assets, ("source",), mapped=True)
    done = ingest(df, str(tmp_path / "h"), assets, ("source",), mapped=True)
    assert done.issues == {"nothing_left": 1} and done.figures["rows_persisted"] == 0 and done.source.count() == 0
    made = ingest_synthetic(spark.createDataFrame(daily(3), TELEMETRY_DDL).withColumn("source_type", F.lit("REAL")), str(tmp_path / "s"), assets, ("source",), mapped=True)
    assert made.figures["rows_persisted"] == 3 and {r.source_type for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"SYNTHETIC"}


def test_lenient_cleaning_counts_zeroed_rates(spark):
    df = spark.createDataFrame(daily(5) + [("A-1", daily(9)[8][1], -4.0, "f", "SYNTHETIC")], TELEMETRY_DDL)
    out, figures = clean.clean_counted(df, ("source",), CleanConfig(negatives="zero", outliers=None))
    assert figures["negative_zeroed"] == 1 and figures["negative_dropped"] == 0 and figures["output_rows"] == 6 == out.count()
    assert figures["production_violations"] == 0 and out.agg(F.min("production")).first()[0] == 0.0


def test_export_csv(spark, tmp_path):
    sinks.export_csv(spark.createDataFrame(daily(3), TELEMETRY_DDL), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_clean_report(spark):
    rows = daily(60) + [(None, None, 1.0, "f", "SYNTHETIC"), ("A-1", daily(1)[0][1], -4.0, "f", "SYNTHETIC")]
    rows[55] = (*rows[55][:2], rows[55][2] + 300, *rows[55][3:])
    df = spark.createDataFrame(rows, TELEMETRY_DDL).withColumn("n", F.monotonically_increasing_id())
    out, seen = clean.clean(df, ("n",), CleanConfig())
    assert out.count() == 59
    assert seen.get["input_rows"] == 62 and seen.get["missing_required_dropped"] == 1 and seen.get["negative_dropped"] == 1


def test_json_layouts_are_told_apart(spark, tmp_path):
    from pyspark.sql.types import StructType

    from fieldspark.sources.mapping import MappingError

    rows = [{"asset": f"A-{i}", "v": i} for i in range(5)]
    layouts = {"lines": "\n".join(json.dumps(r) for r in rows), "list": json.dumps(rows), "pretty": json.dumps(rows, indent=1),
               "wrapped": json.dumps({"records": rows}), "wrapped_pretty": json.dumps({"data": rows}, indent=1)}
    for name, text in layouts.items():
        (tmp_path / name).write_text(text)
        assert readers.read_json(spark, str(tmp_path / name)).count() == 5, name
        assert readers.read_json(spark, str(tmp_path / name), StructType.fromDDL("asset string, v long")).count() == 5, name
    (tmp_path / "other").write_text(json.dumps({"things": rows}))
    with pytest.raises(MappingError):
        readers.read_json(spark, str(tmp_path / "other"))


def _folder(path, files):
    path.mkdir()
    for name, text in files.items():
        (path / name).write_text(text)
    return str(path)


@pytest.mark.parametrize("record", [
    {"id": 1, "items": [{"q": 1}, {"q": 2}]}, {"id": 1, "parts": [{"q": 1}]}, {"id": 1, "data": ["x"]}, {"records": [{"q": 1}]}, {"id": 1, "items": []}])
def test_read_json_keeps_records_that_hold_lists(spark, tmp_path, record):
    rows = [record | {"n": i} for i in range(5)]
    place = _folder(tmp_path / "in", {"a.json": "\n".join(map(json.dumps, rows)) + "\n\n"})
    out = readers.read_json(spark, place)
    assert sorted(r.n for r in out.collect()) == [0, 1, 2, 3, 4] and set(out.columns) == set(rows[0])


def test_read_json_of_mixed_files(spark, tmp_path):
    row = lambda i: {"asset_id": f"A{i}", "v": i}
    place = _folder(tmp_path / "in", {
        "lines.json": "\n".join(json.dumps(row(i)) for i in range(3)), "wrapped.json": json.dumps({"records": [row(3), row(4)], "count": 2}),
        "pretty.json": json.dumps({"data": [row(5)]}, indent=2), "list.json": json.dumps([row(6), row(7)], indent=1), "one.json": json.dumps(row(8)),
        "one_pretty.json": json.dumps(row(9) | {"extra": [{"x": 1}]}, indent=2), "none.json": "", "empty.json": "[]"})
    assert sorted((r.asset_id, r.v) for r in readers.read_json(spark, place).collect()) == sorted((f"A{i}", i) for i in range(10))


@pytest.mark.parametrize("text", ['{"a": 1}\n{"a": 2', '{"a":\n1}\n{"a":\n2}', "[1, 2]", '{"stuff": [{"a": 1}]}', "no json"])
def test_read_json_refuses_what_it_cannot_keep(spark, tmp_path, text):
    with pytest.raises(mapping.MappingError):
        readers.read_json(spark, _folder(tmp_path / "in", {"a.json": text, "b.json": '[{"a": 3}]'}))


def test_ingest_does_not_group_cleaned_rows_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(daily(20) + daily(20), TELEMETRY_DDL).withColumn("n", F.monotonically_increasing_id())
    assets, place = spark.createDataFrame([("A-1",)], "asset_id string"), str(tmp_path / "history")
    looked, real = [], sinks.dedupe
    monkeypatch.setattr(sinks, "dedupe", lambda *a, **k: looked.append(1) or real(*a, **k))
    for stored in (20, 0):
        done = ingest(df, place, assets, ("n",), mapped=True)
        assert done.figures["rows_persisted"] == stored and done.figures["duplicates_removed"] == 20
    assert not looked and spark.read.parquet(place).count() == 20
    # copies that the cleaning leaves are still dropped by the append
    kept = ingest(df, str(tmp_path / "other"), assets, ("n",), CleanConfig(copies=None), mapped=True)
    assert looked and kept.figures["output_rows"] == 40 and kept.figures["rows_persisted"] == 20
