"""Mixing sources to target weights: hash keys, ordering within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import SPACE, staged, word_count
from fieldspark.operators.ranking import global_rank


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    seed: int = 10
    slice_rows: int = 20_000


def source_targets(sources: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): a filling of `share` of all sizes by weight.

    Weights repeat over the sources in code point order, null last. A target stops at `most` times its source's size, the
    rest is shared again by weight among the others until none is above. One round is one small aggregation.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cfg.weights]), (F.pmod(F.col("rank") - 1, len(cfg.weights)) + 1).cast("int"))
    table = staged(ranked.select("source", F.col("source_size").cast("double").alias("source_size"), weight.alias("weight")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0.0
    cap, level = F.col("source_size") * cfg.most, 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        rest, open_weight = table.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if open_weight == 0:
            break
        up = (cfg.share * total - rest) / open_weight
        if up <= level:
            break
        level = up
    return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`carry` columns with source, size, source_size, target and taken, one row per document row.

    Within a source the documents follow a hash key of the id and the text; running sums of words are taken in slices of the
    key range, each slice starting at the sum of those before, so that a source with a third of all rows is spread over many
    tasks. A target is passed whole times first; what is left takes the documents up to the exact word at which it ends, so
    the cut document is taken in part. Reruns agree; equal rows are interchangeable.

    A null text counts 0 words and is never taken; a null source is a source of its own, the last; a null id hashes as null.
    Empty input gives no rows. Carried columns keep their values; those named like an output column are replaced.
    """
    out = {"source", "size", "source_size", "target", "taken"}
    rows = staged(docs.select(
        F.struct(*[docs[c] for c in carry if c not in out]).alias("_row"), source_key(F.col("source")).alias("sid"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(cfg.seed), F.col("doc_id").cast("string"), F.col("text")).alias("key")), "mix")
    slices = max(1, -(-rows.count() // cfg.slice_rows))
    # key >>> 33 is uniform below 2^31: equal ranges of it, in the order of the key
    rows = rows.withColumn("slice", F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(slices), 31))
    sums = staged(rows.groupBy("sid", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    sources = sums.groupBy("sid").agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(sources.withColumn("source", source_of("sid")), cfg).select(
        source_key(F.col("source")).alias("sid"), "source", "source_size", "target")
    before = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).drop("slice_size").join(targets, "sid")
    place = F.shiftrightunsigned("key", 33)
    running = Window.partitionBy("sid", "slice").orderBy(place, "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("in_slice", F.coalesce(F.sum("size").over(running), F.lit(0))).join(starts, ["sid", "slice"])
    all_words = F.col("source_size").cast("long")
    words = F.floor(F.col("target") + 0.5)
    passes = F.when(all_words > 0, F.floor(words / all_words)).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), words - passes * all_words - F.col("start") - F.col("in_slice")))
    return joined.select("_row.*", "source", "size", all_words.alias("source_size"), "target",
                         (passes * F.col("size") + part).cast("long").alias("taken"))


def source_key(source: Column) -> Column:
    """A key without nulls, so that a plain join finds the null source too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_of(key: str) -> Column:
    return F.when(F.col(key) != "n", F.substring(key, 2, 1 << 30))


def mixed_documents(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with all its columns; a cut document ends with the cut.

    Copies differ in nothing. Documents without words are taken by no budget and are left out. The words of a cut document are
    joined by single spaces; there is at most one in each source.
    """
    rows = mix(docs.select("doc_id", "text", "source", F.struct("*").alias("whole")), cfg, carry=("whole",)).where("taken > 0")
    # taken = whole passes times size, plus a part of one more pass
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    text = F.when(words == F.col("size"), F.col("whole.text")).otherwise(
        F.array_join(F.slice(F.filter(F.split(F.col("whole.text"), SPACE), lambda w: w != ""), 1, words.cast("int")), " "))
    return copies.select(*[text.alias("text") if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns])
