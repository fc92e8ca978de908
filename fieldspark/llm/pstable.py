"""Embedding near-duplicates: p-stable hashing of normalised vectors into several tables, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import map_columns, staged
from fieldspark.llm.graph import components, spanning


@dataclass(frozen=True)
class PStableConfig:
    """Two unit vectors of cosine 0.95 are 0.316 apart: a projection of width 2.5 puts them into one cell with 0.90, all 12
    with 0.28, hence some of 20 tables miss them all in 0.14 % of the cases. Unrelated vectors (1.41 apart) meet in one table
    with 0.1 %; for hundreds of millions of vectors take more projections, and tables for the recall wanted."""

    cosine: float = 0.95
    width: float = 2.5
    projections: int = 12
    tables: int = 20
    #: vectors of one bucket beyond which it is compared block by block in several tasks
    block: int = 4096
    #: vectors that one task group takes
    group_rows: int = 10_000
    seed: int = 2


def bucket_keys(unit: np.ndarray, cfg: PStableConfig) -> np.ndarray:
    """(vectors, tables) 64-bit keys of the quantised random projections."""
    rng = np.random.default_rng([cfg.seed, unit.shape[1]])
    a = rng.normal(size=(unit.shape[1], cfg.tables * cfg.projections))
    shift = rng.uniform(0, cfg.width, cfg.tables * cfg.projections)
    mix = rng.integers(1, 1 << 62, cfg.tables * cfg.projections, dtype=np.int64) * 2 + 1
    cells = np.floor((unit @ a + shift) / cfg.width).astype(np.int64) * mix
    keys = cells.reshape(len(unit), cfg.tables, cfg.projections).sum(axis=2)
    return keys ^ (keys >> 29)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(distinct: DataFrame, cfg: PStableConfig) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        vectors = [np.asarray(v, np.float64) for v in batch.column(3).to_pylist()]
        keys: list = [None] * len(vectors)
        for dim in {len(v) for v in vectors}:
            own = [i for i, v in enumerate(vectors) if len(v) == dim]
            for i, row in zip(own, bucket_keys(_unit([vectors[i].tobytes() for i in own]), cfg), strict=True):
                keys[i] = row
        return {"node": batch.column(0), "copies": batch.column(1), "first_id": batch.column(2), "vector": [v.tobytes() for v in vectors], "keys": keys}

    return map_columns(distinct.select("node", "copies", "first_id", "vector"), run,
                       "node long, copies long, first_id long, vector binary, keys array<long>")


def _links(own: np.ndarray, others: np.ndarray, same: bool, unit: np.ndarray, keys: np.ndarray, table: int, cfg: PStableConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs of a bucket that meet in no earlier table, some rows at a time."""
    for at in range(0, len(own), 512):
        rows = own[at : at + 512]
        i, j = np.nonzero(unit[rows] @ unit[others].T >= cfg.cosine)
        a, b = rows[i], others[j]
        if same:
            a, b = a[a < b], b[a < b]
        for part in range(0, len(a), 1 << 16):
            x, y = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
            new = ~(keys[x, :table] == keys[y, :table]).any(axis=1)
            yield x[new], y[new]


def _compare(rows: pa.Table, cfg: PStableConfig) -> pa.Table:
    """Links of a group of buckets of one table: how many vectors each node is linked with, and a spanning forest."""
    table, low, high = (rows.column(n)[0].as_py() for n in ("table", "low", "high"))
    node, copies, key, block = (rows.column(n).to_numpy() for n in ("node", "copies", "key", "block"))
    raw = rows.column("vector").to_pylist()
    keys = np.array(rows.column("keys").to_pylist(), np.int64)
    dims = np.array([len(v) for v in raw])
    linked, edges = np.zeros(len(node), np.int64), []
    for dim in np.unique(dims):
        at = np.nonzero(dims == dim)[0]
        unit = np.zeros((len(node), dim // 8))
        unit[at] = _unit([raw[i] for i in at])
        at = at[np.argsort(key[at], kind="stable")]
        cuts = np.nonzero(np.diff(key[at]))[0] + 1
        for bucket in np.split(at, cuts):
            if len(bucket) < 2:
                continue
            own, others = (bucket, bucket) if low == high else (bucket[block[bucket] == low], bucket[block[bucket] == high])
            forest: dict[int, int] = {}
            for x, y in _links(own, others, low == high, unit, keys, table, cfg):
                np.add.at(linked, x, copies[y])
                np.add.at(linked, y, copies[x])
                if len(x):
                    forest = spanning([*forest.items(), *zip(node[x].tolist(), node[y].tolist(), strict=True)])
            edges += forest.items()
    some = linked > 0
    return pa.table({"node": pa.array(np.concatenate([node[some], np.array([a for a, _ in edges], np.int64)])),
                     "other": pa.array([None] * int(some.sum()) + [b for _, b in edges], pa.int64()),
                     "links": pa.array(np.concatenate([linked[some], np.zeros(len(edges), np.int64)]))})


def near_vectors(vectors: DataFrame, cfg: PStableConfig = PStableConfig(), name: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Equal vectors collapse to one node with a number of copies. A bucket with more vectors than `block` is dealt to several
    tasks as pairs of blocks. A pair is counted in the first table in which it meets; only counts and spanning forests leave
    a task. Vectors that are null or empty, have null or non-finite components or are all zero link with nothing, nor do
    vectors of different lengths. Rows with the same id are vectors of their own; a null id never is a component's name, and
    is kept only if alone. Empty input gives no rows.
    """
    value = F.col(name).cast("array<double>")
    fine = value.isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), value).alias("vector"))
    distinct = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    distinct = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    hashed = staged(_hashed(distinct, cfg), "hashed")
    n = hashed.count()
    keyed = hashed.select("node", "copies", "vector", "keys", F.posexplode("keys").alias("table", "key"))
    hot = staged(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cfg.block).select(
        "table", "key", F.ceil(F.col("n") / (cfg.block // 2)).cast("int").alias("blocks")), "hot")
    groups = max(1, -(-n // cfg.group_rows))
    dealt = keyed.join(hot, ["table", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "share", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(groups))))
    dealt = dealt.select("node", "copies", "vector", "keys", "table", "key", "block", "share", (F.col("blocks") > 1).alias("split"),
                         F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = staged(dealt.groupBy("table", "split", "share", "low", "high").applyInArrow(
        lambda t: _compare(t, cfg), "node long, other long, links long"), "links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    groups_of = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = distinct.join(groups_of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    nodes = named.join(smallest, "component").join(counts, "node", "left").select(
        "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = rows.join(nodes, "vector", "left")
    own = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return linked.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                         F.coalesce(F.col("vec_id") == own, F.coalesce("links", F.lit(0)) == 0).alias("kept"))
