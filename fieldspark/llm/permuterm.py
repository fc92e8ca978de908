"""Spelling variants: words one edit apart meet among the sorted rotations of terminator-marked words."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import staged

END = "$"  # the terminator: no letter
#: Latin-1 bytes to lower-case letters, all else to blanks: A-Z, a-z and U+00C0 to U+00FF are letters
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


@dataclass(frozen=True)
class VariantConfig:
    #: code points of a word, at least
    length: int = 6
    #: occurrences of a word, at least
    occurrences: int = 5
    #: a form is at least so many times as frequent
    ratio: int = 5
    #: one of so many (document, run) pairs loses a code point; 0: none
    damage: int = 199
    #: rotations longer than this are keyed by a digest, and their pairs compared as texts
    longest_key: int = 64
    #: distinct words that a task holds before it passes its counts on
    held: int = 300_000


def damaged(run: bytes, prefix: int, every: int) -> bytes:
    """The Latin-1 run, without one code point if the crc32 (continued from the id's) of its UTF-8 form says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n): the words of all texts with their occurrences. Tasks add up before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= cfg.length]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # one byte a code point; what Latin-1 lacks is no letter either
                runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split())
                if cfg.damage:
                    prefix = zlib.crc32(f"{i}:".encode())
                    for w, n in runs.items():
                        total[damaged(w, prefix, cfg.damage)] += n
                else:
                    total.update(runs)
                if len(total) > cfg.held:
                    yield rows()
        yield rows()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rotations(words: DataFrame, cfg: VariantConfig) -> DataFrame:
    """(prefix, skipped, lead, n) of words whose rotations are no longer than cfg.longest_key.

    word = y c x gives x$y once without its code point c (`skipped`), and y x gives x$y whole (skipped is empty). So equal
    prefixes are words with one edit at one place. lead: c isn't the same as the code point before it, so of the equal
    deletions from a run of one letter just the first counts.
    """
    w, size = F.col("word"), F.char_length("word")
    at = F.explode(F.sequence(F.lit(0), size)).alias("i")
    each = words.where(size <= cfg.longest_key).select("word", "n", size.alias("size"), at)
    i, one = F.col("i"), F.lit(1)
    head = F.substring(w, one, i)
    skip = F.struct(F.concat(F.substring(w, i + 2, F.col("size")), F.lit(END), head).alias("prefix"), F.substring(w, i + 1, one).alias("skipped"),
                    ((i == 0) | (F.substring(w, i + 1, one) != F.substring(w, i, one))).alias("lead"))
    whole = F.struct(F.concat(F.substring(w, i + 1, F.col("size")), F.lit(END), head).alias("prefix"), F.lit("").alias("skipped"), F.lit(False).alias("lead"))
    # the last place has no code point to skip; a whole rotation beyond the bound meets digests, not texts
    both = F.filter(F.array(F.when(i < F.col("size"), skip), F.when(F.col("size") < cfg.longest_key, whole)), lambda r: r.isNotNull())
    return each.select("n", F.explode(both).alias("r")).select("r.prefix", "r.skipped", "r.lead", "n")


def _short(words: DataFrame, cfg: VariantConfig) -> DataFrame:
    """(word, n_near, best): for each word and place where it has neighbours, their number and the best (-n, word) of them.

    The rotations are dealt by prefix and sorted; a prefix has at most one whole rotation and one for each letter of the
    alphabet, so a scan holds at most that many rows.
    """
    group = Window.partitionBy("prefix")
    word = F.concat(F.substring_index("prefix", END, -1), "skipped", F.substring_index("prefix", END, 1))
    rows = _rotations(words, cfg).withColumns({"whole": F.col("skipped") == "", "entry": F.struct((-F.col("n")).alias("rank"), word.alias("word"))})
    of = lambda cond: F.collect_list(F.when(cond, F.col("entry"))).over(group)
    rows = rows.withColumns({"size": F.count(F.lit(1)).over(group)}).where("size > 1").withColumns(
        {"skips": F.sort_array(of(~F.col("whole"))), "leads": F.sort_array(of(F.col("lead"))), "deleted": of(F.col("whole"))})
    others = F.slice(F.filter(F.slice("skips", 1, 2), lambda e: e != F.col("entry")), 1, 1)  # the best replacement but itself
    seen = F.when(F.col("whole"), F.size("leads")).otherwise(F.size("skips") - 1 + F.when(F.col("lead"), F.size("deleted")).otherwise(0))
    best = F.when(F.col("whole"), F.slice("leads", 1, 1)).otherwise(F.when(F.col("lead"), F.concat(others, "deleted")).otherwise(others))
    return rows.select(F.col("entry.word").alias("word"), seen.cast("long").alias("n_near"), F.array_min(best).alias("best")).where("n_near > 0")


def _ring_hashes(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit polynomial hashes of a word's rotations: without the code point at each place, and whole from each place on."""
    n = len(codes)
    up = np.cumprod(np.concatenate([[1], np.full(n + 1, base, np.uint64)]).astype(np.uint64), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[1], np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)]).astype(np.uint64), dtype=np.uint64)
    sums = np.concatenate([[0], np.cumsum(codes * up[:n], dtype=np.uint64)]).astype(np.uint64)
    i = np.arange(n + 1)
    whole = (sums[n] - sums) * down[i] + sums * up[n - i + 1]
    skip = (sums[n] - sums[1:]) * down[i[1:]] + sums[:n] * up[n - i[:n]]
    return skip, whole


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # any odd numbers


def _digests(words: DataFrame, cfg: VariantConfig) -> DataFrame:
    """(id, size, h1, h2, whole) of rotations beyond cfg.longest_key, of `size` code points: as texts they would grow with the square."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.uint64), len(word)
                (s1, w1), (s2, w2) = (_ring_hashes(codes, base) for base in BASES)
                skips = n if n > cfg.longest_key else 0  # a word of that length has neighbours here by one more code point only
                sizes = np.concatenate([np.full(skips, n), np.full(n + 1, n + 1)])
                both = [np.concatenate([s[:skips], w]).view(np.int64) for s, w in ((s1, w1), (s2, w2))]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(sizes), pa.string()), pa.array(sizes, pa.int64()), *map(pa.array, both),
                                                  pa.array(np.arange(len(sizes)) >= skips)], names=["id", "size", "h1", "h2", "whole"])

    return words.mapInArrow(run, "id string, size long, h1 long, h2 long, whole boolean")


def _long(words: DataFrame, cfg: VariantConfig) -> DataFrame:
    """(word, n_near, best) like _short for edits of words beyond cfg.longest_key: hashes find pairs, which are compared as texts."""
    texts = words.where(F.char_length("word") >= cfg.longest_key).withColumn("id", F.md5(F.col("word").cast("binary")))
    ranges = _digests(texts.select("id", "word"), cfg).groupBy("size", "h1", "h2").agg(F.collect_set(F.struct("id", "whole")).alias("m")).where(F.size("m") > 1)
    pairs = ranges.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where(
        (F.col("a.id") != F.col("b.id")) & ~(F.col("a.whole") & F.col("b.whole"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    near = pairs.join(texts.select(F.col("id").alias("a"), "word"), "a").join(texts.select(F.col("id").alias("b"), F.col("word").alias("other"), "n"), "b")
    near = near.where(F.levenshtein("word", "other", 1) == 1)
    return near.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("n")).alias("rank"), F.col("other").alias("word")).alias("best"))


def neighbours(words: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a near word; words is (word, n), distinct. form: the best near word, any n."""
    found = _short(words, cfg)
    if not words.where(F.char_length("word") > cfg.longest_key).isEmpty():
        found = found.unionByName(_long(words, cfg))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return best.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.rank")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. Each round doubles the steps; forms grow by a factor, so chains are short."""
    chain = forms.select("word", F.col("form").alias("root"))
    while True:
        chain = staged(chain, "roots")
        up = chain.select(F.col("word").alias("root"), F.col("root").alias("up"))
        further = chain.join(up, "root", "left")
        if further.where(F.col("up").isNotNull()).isEmpty():
            return chain
        chain = further.select("word", F.coalesce("up", "root").alias("root"))


def variants(docs: DataFrame, cfg: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row per word of the documents.

    Words are the lower-cased runs of letters that are long and frequent enough, after one of cfg.damage (document, run) pairs
    has lost a code point. form is the most frequent word one edit away (ties: the smallest), if it is cfg.ratio times as
    frequent; root follows the forms to the last. Null and empty texts have no words; a null id counts as the empty id;
    repeated rows count as often as they are there; words of any length are compared. Empty input gives no rows. Other columns
    are not read.

    All rotations of the words, marked with their end, are sorted; a replaced, missing or additional code point is the one
    that follows a shared prefix, so neighbours stand in one prefix range. Ranges are bounded by the alphabet.
    """
    words = staged(word_counts(docs, cfg).where(F.col("n") >= cfg.occurrences), "words")
    near = staged(neighbours(words, cfg), "neighbours")
    rows = words.join(near, "word", "left")
    enough: Column = F.col("form_n") >= cfg.ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"),
                       F.when(enough, F.col("form_n")).alias("form_n"))
    forms = rows.where("form IS NOT NULL")
    return rows.join(_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
