"""What the operators of this package share: word counts, Arrow maps, tables written between stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldspark.session import scratch_path

#: White space between words; everything else belongs to a word. The same characters as bytes.split() uses.
SPACE = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and safe when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def text_of(docs: DataFrame) -> Column:
    return docs["text"].cast("string")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType, setup: Callable | None = None) -> DataFrame:
    """Apply fn to each Arrow batch; it returns the columns of `schema`. `setup` runs once per task, its value goes to fn."""
    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            cols = fn(batch, state) if setup else fn(batch)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def doc_crc(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id, which is then in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def bounded(df: DataFrame, rows: int, by: Sequence[Column], size: int | None = None) -> DataFrame:
    """About `rows` rows, never more than 1.2 times as many, chosen by a hash of `by`: the same rows on every run.

    size: the number of rows of df, if it is known already.
    """
    n = df.count() if size is None else size
    if n <= rows:
        return df
    share = rows / n
    return df.where(F.pmod(F.xxhash64(F.lit(20), *by), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(int(1.2 * rows))


class Memo(dict):
    """word -> value, computed once; emptied when it has grown to `most` entries, so that memory stays bounded."""

    def __init__(self, fn: Callable, most: int = 600_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.fn(key)
        return value
