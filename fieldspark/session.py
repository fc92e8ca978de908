"""Session helpers: shared checkpoint folder, lineage cuts, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a machine-local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="fieldspark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 500_000


def join_checked(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a narrow per-key table: broadcast when its counted size is within the bound, a plain equi-join otherwise.

    The broadcast spares shuffling the rows of a very frequent key; in the plain join adaptive execution splits such a key.
    `side` should be pinned (see cut_lineage), so that counting it is cheap.
    """
    small = side.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(side) if small else side, list(keys), how)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def observed(seen: Observation, frame: DataFrame | None, figures: Sequence[Column]) -> dict[str, int] | None:
    """The figures of an observation whose job has ended.

    When a plan turns out to be empty while it runs, the adaptive planner may drop the node that observes, and the figures with
    it; then they are counted over `frame`. None without one.
    """
    try:
        return seen.get
    except Py4JJavaError:
        return frame.agg(*figures).first().asDict() if frame is not None else None
