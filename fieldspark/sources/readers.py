"""File and table sources."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.session import scratch_path
from fieldspark.sources.mapping import MappingError, normalize_header, resolve_columns, to_telemetry, unmapped_columns

WRAPPER_KEYS = ("records", "data", "rows", "items")  # fixed values: keys a JSON payload may wrap its list in


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Without a schema all columns stay text; coercion happens in the mapping, so no inference pass."""
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_json(spark: SparkSession, path: str | Sequence[str], record_schema: T.StructType | None = None,
              lines: bool | None = None) -> DataFrame:
    """JSON records: line-delimited, a bare list, or one object that wraps the list; a folder may mix them.

    lines None tells the layouts apart file by file, in one pass over the lines. A file whose lines are objects is
    line-delimited, whatever lists its records hold, and is read in splits. Any other file, and a file of one object, is one
    value by nature of the format: it is unpacked where it is read and its records are written to the scratch folder line by
    line, so all files are read the same way and share one schema. The one object of a file wraps the list of objects that it
    holds under a known key. A file whose value is none of these (no JSON, a list of other things, one object with nothing
    but a list under an unknown key) is an error, so no record is lost. lines True skips the look, lines False takes every
    file as one value.
    """
    reader = spark.read if record_schema is None else spark.read.schema(record_schema)
    if lines:
        return reader.json(path)
    whole, by_line = (None, []) if lines is False else _layouts(spark, path)
    places = list(by_line)
    if whole is None or whole:
        places.append(_unpacked(spark, path if whole is None else whole))
    return reader.json(places)


def _layouts(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """(files that are one value, line-delimited files); one row per file comes to the driver, like the listing itself."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    whole_object = F.startswith(F.col("line"), F.lit("{")) & F.try_parse_json("line").isNotNull()
    files = rows.groupBy("file").agg((F.count_if(whole_object) == F.count(F.lit(1))).alias("objects"), F.count(F.lit(1)).alias("n")).collect()
    return [r["file"] for r in files if not r["objects"] or r["n"] == 1], [r["file"] for r in files if r["objects"] and r["n"] > 1]


def _records(text: str) -> tuple[list[dict], str | None]:
    """The records of a file that is one value, or what is wrong with it."""
    try:
        value = json.loads(text)
    except ValueError as e:
        return [], f"no JSON value: {e}"
    if isinstance(value, dict):
        listed = lambda v: isinstance(v, list) and all(isinstance(x, dict) for x in v)
        known = [value[k] for k in WRAPPER_KEYS if listed(value.get(k))]
        if not known and len(value) == 1 and all(listed(v) and v for v in value.values()):
            return [], "an object that wraps a list under an unknown key"
        return (known[0] if known else [value]), None
    if isinstance(value, list) and all(isinstance(x, dict) for x in value):
        return value, None
    return [], "neither a list of objects nor an object"


def _unpacked(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The records of files that are one value each, written line by line; the folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records, problem = _records(text.as_py()) if text.as_py().strip() else ([], None)
                rows = [(file, json.dumps(r), None) for r in records] or [(file, None, problem)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["file", "line", "problem"])

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    place = scratch_path(spark, "json-records")
    texts.mapInArrow(run, "file string, line string, problem string").write.parquet(f"{place}/rows")
    rows = spark.read.parquet(f"{place}/rows")
    wrong = rows.where("problem IS NOT NULL").first()
    if wrong:
        raise MappingError(f"{wrong['file']}: {wrong['problem']}")
    rows.where("line IS NOT NULL").select("line").write.text(f"{place}/lines")
    return f"{place}/lines"


def from_df(df: DataFrame, column_map: Mapping[str, str] | None = None, source_type: str | None = None,
            strict: bool = True) -> DataFrame:
    """Any DataFrame (Parquet, ORC, JDBC, Kafka, ...) as telemetry."""
    return to_telemetry(df, column_map, source_type, strict)


def load_public_csv(spark: SparkSession, path: str, column_map: Mapping[str, str] | None = None, **options) -> DataFrame:
    """Published CSV: headers lowered, every row tagged REAL."""
    raw = read_csv(spark, path, **options)
    lowered = raw.toDF(*[normalize_header(c) for c in raw.columns])
    return to_telemetry(lowered.drop("source_type"), column_map, "REAL", strict=False)


def observed_load(df: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """The same frame with row count and provenance metrics gathered while it is used, without a second pass."""
    seen = Observation(name)
    out = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.count_if(F.col("source_type") == "REAL").alias("real_rows"),
        F.count_if(F.col("source_type") == "SYNTHETIC").alias("synthetic_rows"),
        F.count_if(F.col("source_type") == "DERIVED").alias("derived_rows"),
    )
    return out, seen


def load_summary(df: DataFrame, raw_columns: Sequence[str] | None = None,
                 column_map: Mapping[str, str] | None = None) -> DataFrame:
    """One row: counts, time range, provenance, and the raw columns that were not mapped."""
    left = unmapped_columns(raw_columns, resolve_columns(raw_columns, column_map)) if raw_columns else []
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.array_join(F.sort_array(F.collect_set("source_type")), ",").alias("source_types"),
    ).withColumn("unmapped", F.lit(",".join(left)))
