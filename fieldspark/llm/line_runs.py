"""Exact line deduplication with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import staged

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 63  # positions in one mask


@dataclass(frozen=True)
class LineConfig:
    min_chars: int = 10
    #: batches that a whole table is dealt into, by ranges of doc_id
    batches: int = 4
    #: runs of one level that are merged into one of the next
    fanout: int = 2


def hashes(value: Column) -> list[Column]:
    """Two independent 64-bit hashes of one value."""
    return [F.xxhash64(F.lit(1), value), F.xxhash64(F.lit(2), value)]


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) for each line whose key has at least min_chars code points.

    t1 and t2 are hashes of the text; with doc_id they name a document's row, also where ids repeat.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = hashes(text)
    lines = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(F.translate(text, UPPER, LOWER), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.char_length("line") >= min_chars)
    h1, h2 = hashes(F.col("line"))
    return lines.select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


@dataclass
class LineRuns:
    """Sorted runs (h1, h2, owner) in the shared folder; a key is in one run only, with the smallest id that holds it.

    Batches come in ascending order of doc_id; within one batch the smallest id owns a key, a null id comes after all
    others. A level holds fewer than `fanout` runs: when it is full, its runs are merged into one sorted run of the next
    level, so a key is rewritten only as often as there are levels.
    """

    spark: SparkSession
    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, keys: DataFrame) -> DataFrame:
        return staged(keys.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "run")

    def absorb(self, keys: DataFrame) -> DataFrame:
        """Add the new keys of a batch (doc_id, h1, h2, ...) as a run, and return that run before any merging."""
        new = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        new = self._write(new)
        carried, level = new, 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(carried)
            if len(self.levels[level]) < self.fanout:
                return new
            merged = self.levels[level][0]
            for run in self.levels[level][1:]:
                merged = merged.unionByName(run)
            carried, self.levels[level] = self._write(merged), []
            level += 1

    def owned_elsewhere(self, lines: DataFrame) -> DataFrame:
        """The lines whose key belongs to another, smaller id, of a batch that has been absorbed."""
        keys = None
        for run in self.runs():
            keys = run if keys is None else keys.unionByName(run)
        if keys is None:
            return lines.limit(0)
        return lines.join(keys, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("owner")))


def masks(drops: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, masks): dropped positions as a dense array of bit masks, so that a line is looked up by index."""
    name = ["doc_id", "t1", "t2"]
    bits = drops.repartition(*name).groupBy(*name, F.floor(F.col("pos") / BITS).cast("int").alias("block")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % BITS)).alias("mask"))
    blocks = bits.groupBy(*name).agg(F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("by_block"), F.max("block").alias("last"))
    return blocks.select(*name, F.transform(
        F.sequence(F.lit(0), "last"), lambda b: F.coalesce(F.element_at("by_block", b), F.lit(0).cast("long"))).alias("masks"))


def batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of a document's batch: ranges of doc_id with about as many rows each; null ids are in the last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    n = sorted(set(cuts or []))
    number = F.lit(0)
    for cut in n:
        number = number + (F.col("doc_id") > F.lit(cut)).cast("int")
    return F.when(F.col("doc_id").isNull(), F.lit(len(n))).otherwise(number)


def dedup_lines(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """All columns of docs with the text's repeated lines dropped, and n_lines (before) and n_dropped.

    A line key is the line stripped of white space at both ends with A-Z in lower case. A key of at least `min_chars` code
    points that is in several documents loses all its lines but those in the smallest doc_id that holds it. Rows with the
    same doc_id are one document; null ids are together the last document. A null or empty text is one empty line and comes
    back as an empty text. Tables without rows give none. Columns of docs keep their values; those named n_lines or
    n_dropped are replaced.

    The table is dealt into batches by id; each batch merge-anti-joins the runs and adds its own. One shuffle of texts in the
    end puts the drop masks beside the documents.
    """
    spark = docs.sparkSession
    keyed = line_keys(docs, cfg.min_chars).withColumn("batch", batch_of(docs, cfg.batches))
    keyed = staged(keyed, "lines")
    store = LineRuns(spark, cfg.fanout)
    for i in range(cfg.batches):
        store.absorb(keyed.where(F.col("batch") == i))
    dropped = masks(store.owned_elsewhere(keyed.drop("batch")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = hashes(text)
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), t1.alias("t1"), t2.alias("t2"))
    d = dropped.select(F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "masks")
    rows = whole.join(d, whole["doc_id"].eqNullSafe(d["_d"]) & (whole["t1"] == d["_t1"]) & (whole["t2"] == d["_t2"]), "left")
    lines = F.split(F.coalesce(F.col("_row.text").cast("string"), F.lit("")), "\n", -1)
    mask = lambda i: F.coalesce(F.get("masks", F.floor(i / BITS).cast("int")), F.lit(0).cast("long"))
    kept = F.filter(lines, lambda x, i: F.call_function("shiftright", mask(i), i % BITS).bitwiseAND(F.lit(1)) == 0)
    out = rows.select("_row", F.when(F.col("masks").isNull(), lines).otherwise(kept).alias("_kept"), F.size(lines).cast("long").alias("_n"))
    return out.select(
        *[F.array_join("_kept", "\n").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.col("_n").alias("n_lines"), (F.col("_n") - F.size("_kept")).alias("n_dropped"))
