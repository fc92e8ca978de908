"""Isolation forest over Spark groups.

Spark samples, partitions and groups; one group is (key, tree group) with at most the sample size of rows per tree, and
its trees are grown by a small array helper. Rows are copied once per tree group, so the trees of one key spread over
several tasks. Scores of trained rows come straight from the leaves; other rows walk packed trees in column expressions.
The forest does not depend on partitioning, input order or task retries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldspark.config import ForestConfig
from fieldspark.functions import isolation
from fieldspark.functions.columns import clamp
from fieldspark.operators.quantiles import group_percentiles
from fieldspark.session import BROADCAST_ROWS, cut_lineage, scratch_path

cloudpickle.register_pickle_by_value(isolation)  # the helper travels with the task; executors need no installed package

TREE_GROUPS = 8  # copies of a row that are shuffled; the trees of one key are grown by as many tasks


def average_path(n: Column) -> Column:
    """Mean path length of an unsuccessful search among n points (harmonic sum taken by its logarithmic form)."""
    m = n.cast("double")
    body = 2.0 * (F.log(m - 1.0) + 0.5772156649015329) - 2.0 * (m - 1.0) / m
    return F.when(m > 2, body).when(m == 2, 1.0).otherwise(0.0)


def _harmonic_table(limit: int) -> list[float]:
    table, total = [0.0, 0.0], 0.0
    for m in range(2, limit + 1):
        total += 1.0 / (m - 1)
        table.append(2.0 * total - 2.0 * (m - 1) / m)
    return table


def harmonic_path(n: Column, limit: int) -> Column:
    """The same with the exact harmonic sum, looked up for n up to the sample size."""
    return F.get(F.expr("array(" + ", ".join(f"{v!r}D" for v in _harmonic_table(limit)) + ")"), n.cast("int"))


def tree_depth(sample: int) -> int:
    return max(int(math.ceil(math.log2(max(sample, 2)))), 1)


def _array_rows(df: DataFrame, row_key: str, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.select(
        *keys, F.col(row_key).alias("_row"), F.col(row_key).cast("string").alias("_rk"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))


def _groups(df: DataFrame, row_key: str, features: Sequence[str], keys: list[str], config: ForestConfig, presample: bool):
    """Rows copied per tree group; with presample only the sampled (row, tree) pairs, with a `tree` column."""
    groups = min(TREE_GROUPS, config.trees)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _array_rows(df, row_key, features, keys)
    if not presample and keys:
        copies = rows.withColumn("_grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return copies.repartition(parts, *keys, "_grp").groupBy(*keys, "_grp")
    return tree_samples(rows, keys, config).withColumn("_grp", F.pmod("tree", F.lit(groups))).groupBy(*keys, "_grp")


def tree_samples(rows: DataFrame, keys: Sequence[str], config: ForestConfig, expected: float | None = None) -> DataFrame:
    """Per key and `tree` the `config.sample` rows with the smallest hashes of (seed, tree, `_rk`), exactly.

    From one count per key a bound on the hash follows under which about `expected` rows lie (default: well above the sample),
    and a (row, tree) pair over it is dropped where the row is read. So about trees x expected pairs are written and sorted,
    not trees x rows. A (key, tree) with fewer pairs than its sample is drawn again under an eightfold bound, up to all rows.
    Runs jobs; needs the columns `_rk` and the keys.
    """
    keys, spark = list(keys), rows.sparkSession
    expected = config.sample + 8.0 * math.sqrt(config.sample) + 16.0 if expected is None else expected
    ids = [f"_k{i}" for i in range(len(keys))]
    counts = cut_lineage(rows.groupBy(*[F.col(k).alias(i) for k, i in zip(keys, ids)]).agg(F.count(F.lit(1)).alias("_n")))
    asked = counts.withColumn("_trees", F.sequence(F.lit(1), F.lit(config.trees)))

    def joined(left: DataFrame, side: DataFrame, how: str, names: Sequence[str]) -> DataFrame:
        match = F.lit(True)
        for k, i in zip(names, ids):
            match = match & left[k].eqNullSafe(side[i])
        small = not ids or side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return left.join(F.broadcast(side) if small else side, match, how)

    done: DataFrame | None = None
    while True:
        hashed = F.transform("_trees", lambda t: F.struct(
            t.alias("tree"), F.md5(F.concat_ws(":", F.lit(str(config.seed)), t.cast("string"), F.col("_rk"))).alias("_h")))
        # the bound as fifteen hexadecimal digits, as the hash is text
        share = F.lit(float(expected)) / F.col("_n")
        bound = F.lower(F.lpad(F.hex(F.floor(share * F.lit(float(2 ** 60))).cast("long")), 15, "0"))
        held = joined(rows, asked, "inner", keys).withColumn("_bound", F.when(share < 1, bound))
        under = F.filter(hashed, lambda p: F.col("_bound").isNull() | (F.substring(p["_h"], 1, 15) < F.col("_bound")))
        place = scratch_path(spark, "forest")
        held.select(*rows.columns, "_n", F.explode(under).alias("_p")).select(*rows.columns, "_n", "_p.*").write.parquet(place)
        pairs = spark.read.parquet(place)
        found = pairs.groupBy(*[F.col(k).alias(i) for k, i in zip(keys, ids)], "tree").agg(F.count(F.lit(1)).alias("_found"))
        wanted = asked.select(*[F.col(i).alias(f"_w{i}") for i in ids], "_n", F.explode("_trees").alias("_t"))
        match = F.col("_t") == F.col("tree")
        for i in ids:
            match = match & F.col(f"_w{i}").eqNullSafe(F.col(i))
        short = wanted.join(found, match, "left").where(
            F.coalesce("_found", F.lit(0)) < F.least(F.lit(config.sample), "_n")).groupBy(
            *[F.col(f"_w{i}").alias(i) for i in ids], "_n").agg(F.collect_list("_t").alias("_trees"))
        short = cut_lineage(short)
        again = not short.isEmpty()
        full = pairs
        if again:
            lacking = short.select(*ids, F.explode("_trees").alias("_t"))
            match = pairs["tree"] == lacking["_t"]
            for k, i in zip(keys, ids):
                match = match & pairs[k].eqNullSafe(lacking[i])
            full = pairs.join(lacking, match, "left_anti")
        done = full if done is None else done.unionByName(full)
        if not again:
            break
        asked, expected = short, expected * 8.0
    first = F.row_number().over(Window.partitionBy(*keys, "tree").orderBy("_h", "_rk"))
    return done.withColumn("_rn", first).where(F.col("_rn") <= config.sample).drop("_h", "_rn", "_n")


def _grow_with(df: DataFrame, row_key: str, features: Sequence[str], keys: Sequence[str], config: ForestConfig, presample: bool,
               splits: bool) -> DataFrame:
    keys = list(keys)
    fields = [df.schema[k] for k in keys] + [T.StructField("tree", T.IntegerType())]
    if splits:
        fields += [T.StructField("node", T.LongType()), T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
                   T.StructField("depth", T.IntegerType()), T.StructField("size", T.LongType())]
    else:
        fields += [T.StructField(row_key, df.schema[row_key].dataType), T.StructField("node", T.LongType()),
                   T.StructField("depth", T.IntegerType()), T.StructField("size", T.LongType())]
    schema = T.StructType([*fields, T.StructField("psi", T.LongType())])
    out_types = to_arrow_schema(schema)
    width, groups, levels, n_keys = len(features), min(TREE_GROUPS, config.trees), tree_depth(config.sample), len(keys)
    trees_all, sample, seed = config.trees, config.sample, config.seed

    def build(key: tuple, table: pa.Table) -> pa.Table:
        values = [k.as_py() for k in key[:n_keys]]
        group = key[n_keys].as_py()
        flat = table.column("_x").combine_chunks().flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        if "tree" in table.column_names:
            tree, row = table.column("tree").to_numpy().astype(np.int64), np.arange(table.num_rows)
        else:
            mine = [t for t in range(1, trees_all + 1) if t % groups == group]
            tree, row = isolation.sample_rows(table.column("_rk").to_pylist(), mine, sample, seed)
        prefix = ":".join([str(seed), *[str(v) for v in values]]) + ":"
        node, depth, size, cuts = isolation.grow(x, tree, row, levels, prefix)
        ids, counts = np.unique(tree, return_counts=True)
        psi = dict(zip(ids.tolist(), counts.tolist()))
        if splits:
            leaves = {(int(t), int(n)): (int(d), int(z)) for t, n, d, z in zip(tree, node, depth, size)}
            records = [(t, n, f, c, None, None, psi[t]) for t, n, f, c in cuts.tolist()]
            records += [(t, n, None, None, d, z, psi[t]) for (t, n), (d, z) in leaves.items()]
            cols = [list(c) for c in zip(*records)]
        else:
            cols = [tree, table.column("_row").take(pa.array(row)), node, depth, size, np.array([psi[t] for t in tree.tolist()])]
        total = len(cols[0])
        arrays = [pa.array([v] * total, type=out_types.field(i).type) for i, v in enumerate(values)]
        for i, c in enumerate(cols):
            kind = out_types.field(n_keys + i).type
            arrays.append(c.cast(kind).combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, type=kind))
        return pa.Table.from_arrays(arrays, names=out_types.names)

    return _groups(df, row_key, features, keys, config, presample).applyInArrow(build, schema)


def grow(
    df: DataFrame, row_key: str, features: Sequence[str], keys: Sequence[str] = ("asset_id",),
    config: ForestConfig = ForestConfig(), presample: bool = False,
) -> DataFrame:
    """One row per (key, tree, sampled row): leaf id, depth, leaf size and the sample size `psi`.

    A row joins a tree's sample when it is among the `sample` smallest hashes of (seed, tree, row). With presample the
    pairs are cut where the rows are read (see tree_samples); use it where a key may hold many more rows than the sample.
    Without it a key's rows travel whole, which suits monthly panels. A feature that is NULL for a key is never split.
    """
    return _grow_with(df, row_key, features, keys, config, presample, splits=False)


def grow_nodes(
    df: DataFrame, row_key: str, features: Sequence[str], keys: Sequence[str] = ("asset_id",),
    config: ForestConfig = ForestConfig(), presample: bool = False,
) -> DataFrame:
    """The same forest as a node table: inner nodes with feature and split, leaves with depth and size."""
    return _grow_with(df, row_key, features, keys, config, presample, splits=True)


def leaf_path(config: ForestConfig) -> Column:
    extra = harmonic_path(F.col("size"), config.sample) if config.leaf_correction else F.lit(0.0)
    return F.col("depth") + extra


def pack(nodes: DataFrame, keys: Sequence[str] = ("asset_id",), config: ForestConfig = ForestConfig()) -> DataFrame:
    """Node table -> one row per key: `trees`, arrays of nodes with child positions (0 marks a leaf), and `psi`.

    Bounded by trees x twice the sample size.
    """
    keys = list(keys)
    path = F.when(F.col("feature").isNull(), leaf_path(config)).otherwise(0.0)
    per_tree = nodes.withColumn("path", path).groupBy(*keys, "tree").agg(
        F.array_sort(F.collect_list(F.struct("node", "feature", "split", "path"))).alias("n"), F.max("psi").alias("psi"))
    ids = per_tree.withColumn("_ids", F.transform("n", lambda x: x["node"]))
    linked = ids.select(*keys, "tree", "psi", F.transform("n", lambda x: F.struct(
        x["feature"].alias("feature"), x["split"].alias("split"), x["path"].alias("path"),
        F.when(x["feature"].isNull(), 0).otherwise(F.array_position("_ids", x["node"] * 2)).cast("int").alias("left"),
        F.when(x["feature"].isNull(), 0).otherwise(F.array_position("_ids", x["node"] * 2 + 1)).cast("int").alias("right"),
    )).alias("nodes"))
    return linked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"]).alias("trees"),
        F.max("psi").alias("psi"))


def path_length(trees: Column, x: Column, depth: int) -> Column:
    """Mean path of a feature array through packed trees; row-local."""
    def one(nodes: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            n = F.element_at(nodes, at)
            return F.when(n["left"] == 0, at).when(F.get(x, n["feature"]) < n["split"], n["left"]).otherwise(n["right"])
        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)
        return F.element_at(nodes, leaf)["path"]
    paths = F.transform(trees, one)
    return F.aggregate(paths, F.lit(0.0), lambda a, p: a + p) / F.size(trees)


def _raw(path: Column, c: Column) -> Column:
    # rounded so that equal mean paths tie exactly, whatever the order in which the trees were summed
    return F.round(F.when(c > 0, F.pow(F.lit(2.0), -path / c)).otherwise(0.0), 12)


def score_rows(df: DataFrame, forest: DataFrame, features: Sequence[str], keys: Sequence[str] = ("asset_id",),
               config: ForestConfig = ForestConfig(), normaliser: Column | None = None) -> DataFrame:
    """Adds raw_score = 2^(-mean path / c) for any rows, seen or unseen in training.

    Keyed forests join on the key (adaptive execution splits a key with very many rows); a pooled forest is one bounded
    row and is broadcast.
    """
    keys = list(keys)
    x = F.array(*[F.col(f).cast("double") for f in features])
    if keys:
        held = df.join(forest, keys)
    else:
        held = df.withColumn("_one", F.lit(1)).join(F.broadcast(forest.withColumn("_one", F.lit(1))), "_one").drop("_one")
    c = harmonic_path(F.col("psi"), config.sample) if normaliser is None else normaliser
    path = path_length(F.col("trees"), x, tree_depth(config.sample))
    return held.withColumn("raw_score", _raw(path, c)).drop("trees", "psi")


def score_training(grown: DataFrame, row_key: str, keys: Sequence[str] = ("asset_id",),
                   config: ForestConfig = ForestConfig()) -> DataFrame:
    """(key, row, raw_score) for rows that are in every sample, straight from the build, without a second walk."""
    keys = list(keys)
    out = grown.groupBy(*keys, row_key).agg(F.avg(leaf_path(config)).alias("path"), F.max("psi").alias("psi"))
    return out.select(*keys, row_key, _raw(F.col("path"), harmonic_path(F.col("psi"), config.sample)).alias("raw_score"))


def score_every(df: DataFrame, row_key: str, features: Sequence[str], keys: Sequence[str] = ("asset_id",),
                config: ForestConfig = ForestConfig()) -> DataFrame:
    """(key, row, raw_score) for every row of df, whether it is in a tree's sample or not: grown and walked in one pass.

    A key's rows travel whole, which suits monthly panels; of each row only the summed path comes back. The rows of a key that
    fit into a sample go once, to one task that grows all its trees; a key with more rows goes to a task for each of its tree
    groups. For keys with very many rows grow on a presample and use score_rows.
    """
    keys = list(keys)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(row_key, df.schema[row_key].dataType),
                           T.StructField("path", T.DoubleType()), T.StructField("trees", T.LongType()), T.StructField("psi", T.LongType())])
    out_types = to_arrow_schema(schema)
    width, groups, levels, n_keys = len(features), min(TREE_GROUPS, config.trees), tree_depth(config.sample), len(keys)
    trees_all, sample, seed = config.trees, config.sample, config.seed
    extra = np.array(_harmonic_table(sample)) if config.leaf_correction else np.zeros(sample + 1)

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        values, group = [k.as_py() for k in key[:n_keys]], key[n_keys].as_py()
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        mine = [t for t in range(1, trees_all + 1) if group is None or t % groups == group]
        tree, row = isolation.sample_rows(table.column("_rk").to_pylist(), mine, sample, seed)
        node, depth, size, splits = isolation.grow(x, tree, row, levels, ":".join([str(seed), *[str(v) for v in values]]) + ":")
        path, trees = isolation.path_sums(x, tree, row, node, depth, size, splits, levels, extra)
        n = table.num_rows
        columns = [*[[v] * n for v in values], table.column("_row").combine_chunks(), path, [trees] * n, [min(n, sample)] * n]
        return pa.Table.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                     for c, f in zip(columns, out_types)], names=out_types.names)

    rows = _array_rows(df, row_key, features, keys).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    several = F.sequence(F.lit(0), F.lit(groups - 1))
    copies = rows.withColumn("_grp", F.explode(F.when(F.col("_all") > sample, several).otherwise(F.array(F.lit(None).cast("int"))))).drop("_all")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = copies.repartition(parts, *keys, "_grp").groupBy(*keys, "_grp").applyInArrow(walk, schema)
    mean = F.sum("path") / F.sum("trees")
    out = sums.groupBy(*keys, row_key).agg(mean.alias("path"), F.max("psi").alias("psi"))
    return out.select(*keys, row_key, _raw(F.col("path"), harmonic_path(F.col("psi"), config.sample)).alias("raw_score"))


FLAT = "start array<int>, feature array<int>, cut array<double>, left array<int>, path array<double>"


def fit_model(df: DataFrame, row_key: str, features: Sequence[str], keys: Sequence[str] = ("asset_id",),
              config: ForestConfig = ForestConfig(), presample: bool = False) -> DataFrame:
    """The forest of each key as a table: (keys, part, psi) and the flat breadth-first arrays of a part of its trees.

    The same trees as `grow`. A key has a row for each of the eight tasks that grow its trees, with at most two nodes for
    each sampled row and tree.
    """
    keys = list(keys)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("part", T.IntegerType()), T.StructField("psi", T.LongType()),
                           *T.StructType.fromDDL(FLAT).fields])
    out_types = to_arrow_schema(schema)
    width, groups, levels, n_keys = len(features), min(TREE_GROUPS, config.trees), tree_depth(config.sample), len(keys)
    trees_all, sample, seed = config.trees, config.sample, config.seed
    extra = np.array(_harmonic_table(sample)) if config.leaf_correction else np.zeros(sample + 1)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        values, group = [k.as_py() for k in key[:n_keys]], key[n_keys].as_py()
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        if "tree" in table.column_names:
            tree, row = table.column("tree").to_numpy().astype(np.int64), np.arange(table.num_rows)
        else:
            tree, row = isolation.sample_rows(table.column("_rk").to_pylist(), [t for t in range(1, trees_all + 1) if t % groups == group], sample, seed)
        grown = isolation.grow(x, tree, row, levels, ":".join([str(seed), *[str(v) for v in values]]) + ":")
        flat = isolation.flatten(tree, *grown, extra)
        psi = len(row) // max(len(flat.start), 1)
        cols = [*values, group, psi, flat.start, flat.feature, flat.cut, flat.left, flat.path]
        return pa.Table.from_arrays([pa.array([c], type=f.type) for c, f in zip(cols, out_types)], names=out_types.names)

    return _groups(df, row_key, features, keys, config, presample).applyInArrow(build, schema)


def score_model(df: DataFrame, model: DataFrame, row_key: str, features: Sequence[str], keys: Sequence[str] = ("asset_id",),
                config: ForestConfig = ForestConfig(), slices: Column | None = None) -> DataFrame:
    """(keys, row, raw_score) of any rows by the forests of `model`; rows whose key has none are left out.

    Rows and trees meet in groups of a key, or of a key and one of its `slices` (a column, for keys with very many rows), and
    all trees take a level at once; no row carries a forest.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(row_key).alias("_row"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
                     (F.lit(0) if slices is None else F.xxhash64(slices)).cast("long").alias("_s"))
    trees_of = [*keys, "psi", *[f.name for f in T.StructType.fromDDL(FLAT).fields]]
    held = rows.select(*keys, "_s").distinct().join(model.select(*trees_of).toDF(*trees_of), keys)
    held = held.toDF(*held.columns)  # columns of its own, as rows and model may come from one table
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(row_key, df.schema[row_key].dataType), T.StructField("raw", T.DoubleType())])
    out_types, width, n_keys, levels = to_arrow_schema(schema), len(features), len(keys), tree_depth(config.sample)
    norm = np.array(_harmonic_table(config.sample))

    def walk(key: tuple, table: pa.Table, trees: pa.Table) -> pa.Table:
        if not trees.num_rows or not table.num_rows:
            return out_types.empty_table()
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        total, count = np.zeros(len(x)), 0
        for i in range(trees.num_rows):
            flat = isolation.FlatTrees(*[trees.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("start", "feature", "cut", "left", "path")])
            total, count = total + flat.path_sums(x, levels), count + len(flat.start)
        c = norm[trees.column("psi")[0].as_py()]
        raw = np.power(2.0, -(total / count) / c) if c > 0 else np.zeros(len(x))
        cols = [*[[k.as_py()] * len(x) for k in key[:n_keys]], table.column("_row").combine_chunks(), raw]
        return pa.Table.from_arrays([pa.array(v, type=f.type) if not isinstance(v, pa.Array) else v.cast(f.type) for v, f in zip(cols, out_types)], names=out_types.names)

    out = rows.groupBy(*keys, "_s").cogroup(held.groupBy(*keys, "_s")).applyInArrow(walk, schema)
    return out.select(*keys, row_key, F.round("raw", 12).alias("raw_score"))


def calibrate(scores: DataFrame, keys: Sequence[str] = ("asset_id",), config: ForestConfig = ForestConfig(),
              exact: str = "window") -> DataFrame:
    """Adds iso_score in 0..1: distance above the lower percentile over a widened range, bent by a power.

    "window" suits bounded groups that are already partitioned by the key (no further shuffle); use "bracket" for scores
    of raw telemetry.
    """
    lo, hi, widen, power = config.calibration
    keys = list(keys)
    if exact == "window":
        q = F.percentile("raw_score", F.array(F.lit(lo), F.lit(hi))).over(Window.partitionBy(*keys))
        joined = scores.withColumn("_q", q).withColumns({"_lo": F.col("_q")[0], "_hi": F.col("_q")[1]}).drop("_q")
    else:
        q = group_percentiles(scores, keys, "raw_score", {"_lo": lo, "_hi": hi}, exact).drop("n")
        joined = scores.join(q, keys)
    width = F.greatest((F.col("_hi") - F.col("_lo")) * widen, F.lit(1e-9))
    return joined.withColumn("iso_score", F.pow(clamp((F.col("raw_score") - F.col("_lo")) / width, 0, 1), F.lit(power))
                             ).drop("_lo", "_hi")
