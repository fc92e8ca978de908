"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import staged


def _find(parent: dict, x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x] = root
        x = up
    return root


def spanning(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """node -> smallest node of its part of the given pairs; roots are left out."""
    parent: dict[int, int] = {}
    for a, b in pairs:
        ra, rb = _find(parent, a), _find(parent, b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: _find(parent, x) for x in list(parent)}


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = spanning(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        a, b = np.fromiter(links.keys(), np.int64, len(links)), np.fromiter(links.values(), np.int64, len(links))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edges (a, b), the smallest node reachable. Nodes are longs.

    Each Arrow batch first shrinks to a spanning forest. Then two star steps alternate until nothing changes: a node's
    larger neighbours are tied to its smallest one, then its smaller ones. Every step keeps at most as many edges as it was
    given and is written to the shared folder. Empty edges give no rows.
    """
    edges = staged(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
                 .where("a <> b").distinct())
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
                 .unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        edges = staged(small, "edges")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
