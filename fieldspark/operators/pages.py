"""Stored pages: a table kept in its order, of which any page is read without the ones before it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators.ranking import global_rank
from fieldspark.session import observed

PLACE, BLOCK = "_place", "_block"


def store_pages(df: DataFrame, order: Sequence[Column], path: str, block_rows: int = 100_000) -> int:
    """Writes the rows with their 1-based place in the total order, in folders of `block_rows` places; the number of rows.

    One range shuffle by the order; a folder is written by the tasks whose range it touches. An index of one row keeps the
    number of rows and the width of the folders.
    """
    placed = global_rank(df, order, PLACE).withColumn(BLOCK, F.floor((F.col(PLACE) - 1) / F.lit(block_rows)))
    seen, rows_of = Observation(), F.count(F.lit(1)).alias("rows")
    placed.observe(seen, rows_of).write.mode("overwrite").partitionBy(BLOCK).parquet(f"{path}/rows")
    rows = observed(seen, placed, [rows_of])["rows"]
    df.sparkSession.createDataFrame([(rows, block_rows, placed.schema.json())], "rows bigint, block_rows bigint, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return rows


def page_index(spark: SparkSession, path: str, size: int = 10) -> DataFrame:
    """One row: rows, and pages of `size` (at least one)."""
    return spark.read.parquet(f"{path}/index").select("rows", F.greatest(F.ceil(F.col("rows") / F.lit(size)), F.lit(1)).alias("pages"))


def read_after(spark: SparkSession, path: str, place: int, size: int = 10) -> DataFrame:
    """The `size` rows behind a place, in order, with `_place`; reads only the folders that hold them."""
    index = spark.read.parquet(f"{path}/index").first()
    width = index["block_rows"]
    first, last = max(place, 0) + 1, max(place, 0) + size
    held = spark.read.schema(T.StructType.fromJson(json.loads(index["schema"]))).parquet(f"{path}/rows").where(F.col(BLOCK).between((first - 1) // width, (last - 1) // width) & F.col(PLACE).between(first, last))
    return held.drop(BLOCK).orderBy(PLACE)


def read_page(spark: SparkSession, path: str, number: int = 1, size: int = 10) -> DataFrame:
    """Page `number` (from 1)."""
    return read_after(spark, path, (max(number, 1) - 1) * size, size)
