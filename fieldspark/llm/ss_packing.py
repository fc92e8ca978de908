"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import Memo, staged


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    capacity: int = 4096
    end_id: int = 1
    #: pieces that are packed together; the number of shards grows with the table
    shard_pieces: int = 60_000


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as they are, the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


#: A word of letters with marks behind it, in which neither normal forms nor contractions play a part.
SIMPLE = re.compile(r"([a-zà-öø-ÿ]+)([-.,;:!?*&%$#|()]*)")


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins text across white space and ignores case: each word is encoded once.

    The tokenizer file drops white space and matches its pieces inside words, so the ids of a text are those of its words one
    after another. A simple word goes straight to the tokenizer's model as its letters and the marks behind them; any other is
    encoded in full. Words are kept as little-endian 32-bit ids in a bounded memo.
    """

    def __init__(self, path: str, end_id: int, most: int = 500_000):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model, self.letters = self.full.model, _byte_letters()
        self.words, self.marks = Memo(self._word, most), Memo(self._piece, 10_000)
        self.end = array("I", [end_id]).tobytes()

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if not (simple := SIMPLE.fullmatch(text if text.isascii() else text.lower())):
            return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        body, marks = simple.groups()
        if not body.isascii():
            body = body.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(body)]
        return array("I", ids + self.marks[marks] if marks else ids).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)) + self.end, dtype="<u4")


PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, cfg: PackConfig, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids with the end id: only documents above the capacity are cut.

    row_id is the piece's number in its task, distinct within the table; with_ids adds the column ids, array<int>. A null or
    empty text is the end id alone.
    """
    fields = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(cfg.tokenizer, cfg.end_id)
        row_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py())
                for piece, start in enumerate(range(0, len(ids), cfg.capacity)):
                    own = ids[start : start + cfg.capacity]
                    values = (row_id, doc_id, piece, start, len(own), zlib.crc32(own.tobytes()))
                    for n, v in zip(names, values + ((own.astype(np.int32),) if with_ids else ()), strict=True):
                        cols[n].append(v)
                    row_id += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(names, types, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, fields)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, the longest first.

    n[g] counts the open bins with gap g. An item goes to the gap that makes the sum of n[g]^2 smallest, the tightest of
    equals; a bin is opened only where no open one has room, as the aim is few bins. Full bins count no more.
    """
    n = np.zeros(capacity + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    of, at, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    widest = 0  # no open bin has a larger gap
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        while widest and not n[widest]:
            widest -= 1
        if widest < size:
            gap, bin_ = capacity, opened
            opened += 1
        else:
            now = n[size : widest + 1]
            change = n[: widest + 1 - size] - now
            change[0] = -now[0] - 1 if now[0] else 0  # a bin that gets full leaves the sum: half of -2n + 1, less the 1 that others add
            change = np.where(now > 0, change, np.iinfo(np.int64).max)
            gap = size + int(change.argmin())
            bin_ = by_gap[gap].pop()
            n[gap] -= 1
        of[i], at[i] = bin_, capacity - gap
        left = gap - size
        if left:
            n[left] += 1
            by_gap[left].append(bin_)
            widest = max(widest, left)
    return of, at


def pack(table: DataFrame, cfg: PackConfig, others: tuple[str, ...] = ("doc_id", "piece", "start", "length", "ids_crc32")) -> DataFrame:
    """`others` columns of a written table of pieces, with sequence_id and offset.

    Pieces are dealt to shards by a hash of row_id, so that no key can make a shard large, and each shard is packed alone.
    Its last bins stay as they are: a shard wastes about one sequence.
    """
    n = table.count()
    shards = max(1, -(-n // cfg.shard_pieces))
    capacity = cfg.capacity

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row_id", ignore_index=True)
        of, at = sum_of_squares(own["length"].to_numpy(), capacity)
        return own[list(others)].assign(sequence_id=(np.int64(own["shard"].iloc[0]) << 32) + of, offset=at)

    kinds = dict(table.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in others) + ", sequence_id long, offset long"
    dealt = table.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document row.

    A null id stays null; repeated rows are packed like others. Empty input gives no rows.
    """
    return pack(staged(pieces(docs, cfg), "pieces"), cfg)


def sequences(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids, lengths): the packed sequences themselves; a sequence has `capacity` ids at most."""
    table = staged(pieces(docs, cfg, with_ids=True), "pieces")
    placed = pack(table, cfg, ("row_id",)).join(table, "row_id")
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
