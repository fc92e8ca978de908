"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import map_columns, staged
from fieldspark.llm.graph import components

LOW32 = (1 << 32) - 1
BLOCK = 8192  # shingles that are counted at once


@dataclass(frozen=True)
class SimhashConfig:
    shingle: int = 3
    seed: int = 42
    #: fingerprints under one segment value beyond which the value is split by the other segment's halves
    hot: int = 512


def fingerprint(text: str | None, cfg: SimhashConfig = SimhashConfig()) -> int:
    """64 bits as a signed number: a bit is set where over half of the shingle hashes have it. No words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes, lower() changes A-Z alone
    if not words:
        return 0
    n = max(1, len(words) - cfg.shingle + 1)
    digest, seed, k, counts = xxhash.xxh64_intdigest, cfg.seed, cfg.shingle, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(b" ".join(words[i : i + k]), seed) for i in range(at, min(n, at + BLOCK))], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8)).view(">i8")[0])


def fingerprints(docs: DataFrame, cfg: SimhashConfig = SimhashConfig()) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text, null for a null text."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "th": batch.column(1), "fp": np.array([fingerprint(t, cfg) for t in batch.column(2).to_pylist()], dtype=np.int64)}

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("th"), text.alias("text"))
    return map_columns(narrow, run, "doc_id long, th long, fp long")


def _ball(value: Column, bits: int) -> Column:
    """The values within one bit of a segment."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(value), flips)


def _tagged(value: Column, table: int) -> Column:
    """A segment value with the number of its table, as one long key."""
    return value.bitwiseOR(F.lit(table << 40))


def _segments(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(LOW32))


def near_pairs(fps: DataFrame, cfg: SimhashConfig = SimhashConfig()) -> DataFrame:
    """(a, b): the pairs of distinct fingerprints (column fp, distinct longs) that differ in one or two bits, a < b.

    Of two such fingerprints either the upper halves differ in one bit at most, or the lower halves are equal. So each
    fingerprint is stored under both halves, and looks up the ball of radius 1 around its upper half and its lower half
    itself; complete distances are then verified. A half that very many fingerprints share (`hot`) is looked up together with
    a quarter of the other half: the other halves differ in two bits at most, hence of their quarters either the first ones
    differ in one bit at most or the second ones are equal. No more than 2^16 fingerprints can share such a key.
    """
    high, low = _segments(F.col("fp"))
    index = fps.select("fp", F.explode(F.array(_tagged(high, 0), _tagged(low, 1))).alias("key"))
    probes = fps.select(F.col("fp").alias("x"), F.explode(F.concat(
        F.transform(_ball(high, 32), lambda v: _tagged(v, 0)), F.array(_tagged(low, 1)))).alias("key"))
    hot = staged(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cfg.hot).select("key"), "hot")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("x")))
    if hot.isEmpty():
        found = probes.join(index, "key").where((F.col("x") < F.col("fp")) & (differ <= 2))
        return found.select(F.col("x").alias("a"), F.col("fp").alias("b")).distinct()
    plain = probes.join(index.join(hot, "key", "left_anti"), "key").where((F.col("x") < F.col("fp")) & (differ <= 2))

    def other(fp: str) -> Column:  # the half that the key doesn't hold
        upper, lower = _segments(F.col(fp))
        return F.when(F.shiftright("key", 40) == 0, lower).otherwise(upper)

    first, second = (lambda v: F.shiftrightunsigned(v, 16)), (lambda v: v.bitwiseAND(F.lit(0xFFFF)))
    within = index.join(hot, "key", "left_semi").withColumn("rest", other("fp")).select(
        "fp", "key", F.explode(F.array(_tagged(first(F.col("rest")), 0), _tagged(second(F.col("rest")), 1))).alias("sub"))
    asked = probes.join(hot, "key", "left_semi").withColumn("rest", other("x")).select(
        "x", "key", F.explode(F.concat(F.transform(_ball(first(F.col("rest")), 16), lambda v: _tagged(v, 0)), F.array(_tagged(second(F.col("rest")), 1)))).alias("sub"))
    split = asked.join(within, ["key", "sub"]).where((F.col("x") < F.col("fp")) & (differ <= 2))
    return plain.select("x", "fp").unionByName(split.select("x", "fp")).select(F.col("x").alias("a"), F.col("fp").alias("b")).distinct()


def near_groups(docs: DataFrame, cfg: SimhashConfig = SimhashConfig()) -> DataFrame:
    """(doc_id, th, fp, component, component_id), one row per document row; component is the group's smallest fingerprint.

    Equal fingerprints collapse to one row each before anything is compared. component_id is the smallest doc_id of the
    group; null where no row of the group has an id. Null and empty texts have fingerprint 0, which links like any other.
    Repeated rows are members of one group. Empty input gives no rows.
    """
    marks = staged(fingerprints(docs, cfg), "fingerprints")
    distinct = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = components(near_pairs(distinct.select("fp"), cfg))
    of = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return marks.join(of.join(smallest, "component").select("fp", "component", "component_id"), "fp").select(
        "doc_id", "th", "fp", "component", "component_id")


def keep_one(docs: DataFrame, cfg: SimhashConfig = SimhashConfig()) -> DataFrame:
    """The documents without near duplicates: of each group one row stays, of its smallest doc_id.

    Where several rows share that id, the one with the smallest text hash stays (a null text first); of rows that agree in id and
    text the one with the smallest hash of all columns, the same on every run. Groups without any id keep one row of a null
    id. Columns keep their names and values, whatever they are called; maps can't be hashed and are not allowed.
    """
    # of each group the smallest id (null after all others), then the smallest text hash
    lead = near_groups(docs, cfg).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m"))
    keep = lead.select(F.col("m.doc_id").alias("d"), F.col("m.th").alias("h"))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("th"),
                       F.xxhash64("*").alias("order"))
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["d"]) & rows["th"].eqNullSafe(keep["h"]), "left_semi")
    return kept.groupBy("doc_id", "th").agg(F.min_by("row", "order").alias("row")).select("row.*")
