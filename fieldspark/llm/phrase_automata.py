"""Substring dedup: recurring passages are confirmed, compiled into Aho-Corasick automata and located in the documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import Memo, staged, words_of


@dataclass(frozen=True)
class PhraseConfig:
    #: words of a passage that must recur
    window: int = 50
    #: words of a phrase by which documents that share a window find each other
    phrase: int = 16
    #: words that one piece of a passage begins with; it also holds the rest of its last window
    piece: int = 256

    @property
    def tile(self) -> int:
        """Any window holds a whole tile of the passage it is part of."""
        return self.window // 2


ODD = 0x9E3779B97F4A7C15  # any odd number
INVERSE = pow(ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        out = np.cumprod(out, dtype=np.uint64)
    return out


class Rolling:
    """64-bit hashes of all runs of some words of a text, from hashes of its words."""

    def __init__(self):
        self.words = Memo(lambda w: xxhash.xxh64_intdigest(w, 8), 500_000)
        self.up, self.down = _powers(ODD, 1 << 12), _powers(INVERSE, 1 << 12)

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def runs(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Hash of codes[i:i+size] for each i."""
        n = len(codes)
        if n < size:
            return np.empty(0, np.uint64)
        while len(self.up) < n:
            self.up, self.down = _powers(ODD, 2 * len(self.up)), _powers(INVERSE, 2 * len(self.down))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * self.down[: n - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """Minimum of h[i:i+size] for each i, by doubling."""
    have, out = 1, h
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def marks(codes: np.ndarray, rolling: Rolling, cfg: PhraseConfig) -> np.ndarray:
    """For each window its smallest phrase hash: equal windows have equal marks, and neighbours mostly share theirs."""
    return sliding_min(rolling.runs(codes, cfg.phrase), cfg.window - cfg.phrase + 1) if len(codes) >= cfg.window else np.empty(0, np.uint64)


LAST = (1 << 63) - 1  # stands for a null id: after all others


def _scan(docs: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """(id, t1, t2, n_words, sha, marks) of each row: one pass over the texts, nothing but numbers and digests kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            sizes, digests, found = [], [], []
            for text in batch.column(3):
                words = words_of(text.as_py())
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(marks(rolling.codes(words), rolling, cfg)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests), pa.array(found, pa.list_(pa.int64()))],
                names=["id", "t1", "t2", "n_words", "sha", "marks"])

    return named_texts(docs).mapInArrow(run, "id long, t1 long, t2 long, n_words long, sha string, marks array<long>")


def named_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.lit(1), text).alias("t1"),
                       F.xxhash64(F.lit(2), text).alias("t2"), text.alias("text"))


def _windows(candidates: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """(w, id, at): hash and place of each window whose mark recurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                codes = rolling.codes(words_of(text.as_py()))
                again = np.asarray(own.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                at = np.nonzero(np.isin(marks(codes, rolling, cfg), again))[0]
                w = rolling.runs(codes, cfg.window)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(at), i, np.int64)), pa.array(at.astype(np.int32))], names=["w", "id", "at"])

    return candidates.select("id", "text", "again").mapInArrow(run, "w long, id long, at int")


def _pieces(owners: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """(owner, piece, passages): the text of the confirmed windows that start in a piece of the owner's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"owner": [], "piece": [], "passages": []}
            for i, text, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                at = np.unique(np.asarray(starts, np.int64))
                for own in np.split(at, np.nonzero(np.diff(at // cfg.piece))[0] + 1):
                    runs = np.split(own, np.nonzero(np.diff(own) > 1)[0] + 1)
                    out["owner"].append(i)
                    out["piece"].append(int(own[0]) // cfg.piece)
                    out["passages"].append([b" ".join(words[r[0] : r[-1] + cfg.window]) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(out["owner"], pa.int64()), pa.array(out["piece"], pa.int32()),
                                              pa.array(out["passages"], pa.list_(pa.binary()))], names=["owner", "piece", "passages"])

    return owners.select("id", "text", "starts").mapInArrow(run, "owner long, piece int, passages array<binary>")


class Automaton:
    """Passages of some documents, compiled: each tile's first words are a key, a hit is extended to all equal words around."""

    def __init__(self, passages: dict[tuple[int, bytes], None], cfg: PhraseConfig):
        self.key = min(8, cfg.window - cfg.tile + 1)
        self.cfg, self.passages = cfg, [(owner, p.split(b" ")) for owner, p in passages]
        keys: dict[str, list[tuple[int, int]]] = {}
        for number, (_, words) in enumerate(self.passages):
            for at in range(0, len(words) - self.key + 1, cfg.tile):
                keys.setdefault(f" {b' '.join(words[at : at + self.key]).decode('latin-1')} ", []).append((number, at))
        self.machine = ahocorasick.Automaton()
        for key, places in keys.items():
            self.machine.add_word(key, (len(key), places))
        self.machine.make_automaton()

    def covered(self, doc: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in a run of at least `window` words of a passage whose owner is a smaller document."""
        gone = np.zeros(len(words), bool)
        begins = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])  # of the blank before each word
        done: dict[tuple[int, int], int] = {}
        for end, (size, places) in self.machine.iter(f" {b' '.join(words).decode('latin-1')} "):
            i = int(np.searchsorted(begins, end + 1 - size))
            for number, at in places:
                owner, passage = self.passages[number]
                if owner >= doc or done.get((number, i - at), -1) > i:
                    continue
                a, b, c, d = i, at, i + self.key, at + self.key
                while a and b and words[a - 1] == passage[b - 1]:
                    a, b = a - 1, b - 1
                while c < len(words) and d < len(passage) and words[c] == passage[d]:
                    c, d = c + 1, d + 1
                done[number, i - at] = c
                if c - a >= self.cfg.window:
                    gone[a:c] = True
        return gone


BATCH_BYTES = 1 << 19


def _located(routed: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """(id, t1, t2, n_removed, sha, spans): documents stream through the automaton of the passages dealt to them.

    Documents are taken in groups with some hundred thousand bytes of passages, which bounds an automaton's size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("id", "t1", "t2", "n_removed", "sha", "spans")}
            group, passages, size = [], {}, 0

            def flush(group: list, passages: dict, out: dict = out) -> None:
                machine = Automaton(passages, cfg)
                for i, t1, t2, text in group:
                    words = words_of(text)
                    gone = machine.covered(i, words)
                    kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                    edge = np.nonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))[0]
                    for n, v in zip(out, (i, t1, t2, int(gone.sum()), hashlib.sha256(kept).hexdigest(), edge.tolist()), strict=True):
                        out[n].append(v)

            for i, t1, t2, text, dealt in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                group.append((i, t1, t2, text))
                for own in dealt:
                    for p in own["passages"]:
                        if (own["owner"], p) not in passages:
                            passages[own["owner"], p] = None
                            size += len(p)
                if size >= BATCH_BYTES:
                    flush(group, passages)
                    group, passages, size = [], {}, 0
            if group:
                flush(group, passages)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return routed.select("id", "t1", "t2", "text", "dealt").mapInArrow(
        run, "id long, t1 long, t2 long, n_removed long, sha string, spans array<int>")


def dedup_passages(docs: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans: one row per document row.

    A word is removed if it lies in a window of cfg.window words that also starts in a document with a smaller doc_id, judged
    on the input. spans holds the starts and ends of removed word ranges in turn; null if nothing goes. Rows with one doc_id
    are one document. A null id counts as the largest of all. Null and empty texts have no words. Empty input gives no rows.

    1. One pass marks each window with its smallest phrase hash; equal texts stay as one row of their smallest id, the others
       lose everything if they are a window long. 2. Phrases found in several documents pick the candidate windows, whose
       hashes are counted: those in two documents are confirmed, with the smallest document as owner. 3. The owners' words of
       confirmed windows are cut out as pieces of passages, and dealt to the documents where such windows start. 4. Each group
       of documents compiles the passages dealt to it into an automaton and streams through it; hits are extended word by word,
       so hashes only decide what is compared. Every join is by a document or a hash, none is larger than the windows that
       recur.
    """
    scan = staged(_scan(docs, cfg), "scan")
    texts = staged(scan.groupBy("t1", "t2").agg(F.min("id").alias("first")), "texts")
    first = scan.join(texts, ["t1", "t2"]).where(F.col("id") == F.col("first")).dropDuplicates(["id", "t1", "t2"])
    marked = first.select("id", "t1", "t2", F.explode("marks").alias("h"))
    again = marked.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
    lists = marked.join(again, "h").groupBy("id", "t1", "t2").agg(F.collect_list("h").alias("again"))
    candidates = staged(named_texts(docs).join(lists, ["id", "t1", "t2"]).dropDuplicates(["id", "t1", "t2"]), "candidates")
    found = _windows(candidates, cfg)
    confirmed = staged(found.groupBy("w").agg(F.min(F.struct("id", "at")).alias("m"), F.max("id").alias("high")).where(
        F.col("m.id") < F.col("high")).select("w", F.col("m.id").alias("owner"), F.col("m.at").alias("at")), "confirmed")
    piece = F.floor(F.col("at") / cfg.piece).cast("int").alias("piece")
    starts = confirmed.groupBy(F.col("owner").alias("id")).agg(F.collect_list("at").alias("starts"))
    pieces = staged(_pieces(candidates.join(starts, "id"), cfg), "pieces")
    wanted = confirmed.select("w", "owner", piece)
    pairs = found.select("w", "id").join(wanted, "w").where("owner < id").select("id", "owner", "piece").distinct()
    dealt = pairs.join(pieces, ["owner", "piece"]).groupBy("id").agg(F.collect_list(F.struct("owner", "passages")).alias("dealt"))
    located = staged(_located(candidates.join(dealt, "id"), cfg), "located").withColumnsRenamed({"sha": "new_sha", "id": "i", "t1": "u1", "t2": "u2"})
    rows = scan.drop("marks").join(texts, ["t1", "t2"])
    rows = rows.join(located, (rows["id"] == located["i"]) & (rows["t1"] == located["u1"]) & (rows["t2"] == located["u2"]), "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= cfg.window)
    none = F.sha2(F.lit(""), 256)
    return rows.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, none).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int"))).when(F.col("n_removed") > 0, F.col("spans")).alias("spans"))
