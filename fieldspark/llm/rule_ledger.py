"""Quality rules as a ledger: every rule is evaluated once into a bit, policies and ablations read the bits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import map_columns, words_of

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Rules in the order of their bits: name and the SQL condition on the measures under which a document fails. A rule is never
#: moved or changed once ledgers are stored; a new version of a rule takes the next bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(name for name, _ in RULES))


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside windows of five that are found twice or more in the text, the first one included."""
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often, covered, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if often[gram] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    raw, words = (text or "").encode("utf-8", "surrogatepass"), words_of(text)
    full = [line for line in raw.split(b"\n") if line.split(None, 1)]
    chars = sum(map(len, words))
    if text and not text.isascii():
        chars -= len(raw) - len(text)  # white space is one byte a character, so the rest of the bytes is in words
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(full), len(full) - len(set(full)), repeated_words(words)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, fail_bits), one row per document row: bit i is set where rule i fails.

    A null or empty text has no words and fails few_words alone (its other conditions compare zeros). Repeated rows and null
    ids get rows of their own; empty input gives none.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        found = [measure(t.as_py()) for t in batch.column(1)]
        return {"doc_id": batch.column(0)} | {n: [f[i] for f in found] for i, n in enumerate(names)}

    kind = dict(docs.dtypes)["doc_id"]
    rows = map_columns(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, {MEASURES}")
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("fail_bits", bits)


def failed(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept` and `policy`: nothing is measured again."""
    return rows.withColumn("kept", ~failed(policy)).withColumn("policy", F.lit(policy.version))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """(rule, n_failed, n_failed_alone, n_kept, n_kept_without): one pass over the distinct bit sets of a ledger.

    n_failed_alone counts documents that this rule alone keeps out, which a policy without it would keep. Rules outside the
    policy have no row.
    """
    active = rows.select(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits"))
    sets = active.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))  # 2^rules rows at most
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                                for i, (name, _) in enumerate(RULES) if name in policy.rules]))
    each = sets.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits") == 0).alias("n_kept"), total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"))
