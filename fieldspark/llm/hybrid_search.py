"""Ranked lexical search: short lists are summed term at a time, long ones are skipped through document at a time."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import staged

#: UTF-8 bytes to term bytes in lower case, all else to blanks: ASCII letters and digits and every other code point belong to terms
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class SearchConfig:
    #: documents and postings of a segment, at most (a longer document makes a segment of its own)
    segment_docs: int = 32_768
    segment_postings: int = 3_000_000
    #: a list of at most 1/short of a segment's documents is short
    short: int = 64
    #: documents that are skipped or evaluated together
    block: int = 2048
    #: (item, term) rows that are searched together; they are sent to the tasks
    block_terms: int = 200_000


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


@dataclass(frozen=True)
class Index:
    """lists: (segment, term, df, docs, tfs), documents by their place in the segment; segments: (segment, ids, sizes)."""
    lists: DataFrame
    segments: DataFrame


class _Numbers(dict):
    """term -> its number, by first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Segment:
    """Documents of one task while they are gathered."""

    def __init__(self):
        self.numbers = _Numbers()
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.postings += len(counts)

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        # places follow the ids, so that a smaller place is a smaller id
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        term = np.concatenate([self.terms[i] for i in order])
        doc = np.repeat(np.arange(len(order), dtype=np.int32), [len(self.terms[i]) for i in order])
        tf = np.concatenate([self.tfs[i] for i in order])
        by = np.argsort(term, kind="stable")
        doc, tf, ends = doc[by], tf[by], np.cumsum(np.bincount(term, minlength=len(self.numbers)))
        names, starts = list(self.numbers), np.concatenate([[0], ends])
        yield _rows(number, [None], np.zeros(2, np.int32), doc[:0], tf[:0], [[self.ids[i] for i in order]], [[self.sizes[i] for i in order]])
        at = 0
        while at < len(names):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + 200_000, "right")) - 1)
            to = min(to, at + 20_000, len(names))
            a, b = starts[at], starts[to]
            yield _rows(number, [w.decode("utf-8", "surrogatepass") for w in names[at:to]], (starts[at : to + 1] - a).astype(np.int32), doc[a:b], tf[a:b],
                        [None] * (to - at), [None] * (to - at))
            at = to


SCHEMA = "segment long, term string, df int, docs array<int>, tfs array<int>, ids array<long>, sizes array<long>"


def _rows(number: int, terms: list, offsets: np.ndarray, docs: np.ndarray, tfs: np.ndarray, ids: list, sizes: list) -> pa.RecordBatch:
    long, listed = pa.list_(pa.int64()), [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (docs, tfs)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(np.diff(offsets), pa.int32()), *listed, pa.array(ids, long), pa.array(sizes, long)],
        names=["segment", "term", "df", "docs", "tfs", "ids", "sizes"])


def build_index(docs: DataFrame, cfg: SearchConfig = SearchConfig()) -> Index:
    """The inverted lists of all documents that have a term, segment by segment, in one pass without a shuffle.

    Each task gathers its documents into segments of bounded size; their lists are written to the shared folder, so a segment
    is never made twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if words:
                    segment.add(doc_id, words)
                if segment.postings >= cfg.segment_postings or len(segment.ids) >= cfg.segment_docs:
                    yield from segment.batches(number)
                    number, segment = number + 1, _Segment()
        if segment.ids:
            yield from segment.batches(number)

    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA), "index")
    own = F.col("segment").alias("segment")  # a column of its own in each table, so that they can be joined
    return Index(rows.where("term IS NOT NULL").drop("ids", "sizes"), rows.where("term IS NULL").select(own, "ids", "sizes"))


class _List:
    """A list of a segment with the largest impact in each block of documents."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, edges: np.ndarray):
        self.docs, self.impacts, self.edges, self.starts, self.peaks = docs, impacts, edges, None, None

    def blocked(self) -> _List:
        if self.peaks is None:
            self.starts = np.searchsorted(self.docs, self.edges)
            self.peaks = np.zeros(len(self.edges) - 1, np.int64)
            full = np.nonzero(np.diff(self.starts))[0]
            if len(full):
                self.peaks[full] = np.maximum.reduceat(self.impacts, self.starts[full])
        return self

    def part(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.starts[b], self.starts[b + 1])
        return self.docs[s], self.impacts[s]


class SegmentSearch:
    """The best documents of one segment for items, each a mapping of terms to their number in the item."""

    def __init__(self, lists: dict[str, _List], n_docs: int, cfg: SearchConfig):
        self.lists, self.n, self.cfg = lists, n_docs, cfg
        self.edges = np.append(np.arange(0, n_docs, cfg.block), n_docs)
        self.sums = np.zeros(n_docs, np.int64)
        self.evaluated = 0  # documents whose score was followed up, for tests

    def best(self, item: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents with a score above 0; equal scores by place."""
        mine = [(self.lists[t], times) for t, times in item if t in self.lists]
        limit = max(16, self.n // self.cfg.short)
        for entry, times in mine:  # term at a time over the short lists
            if len(entry.docs) <= limit:
                self.sums[entry.docs] += entry.impacts * times
        at = np.flatnonzero(self.sums)
        summed = _List(at, self.sums[at], self.edges).blocked()
        self.sums[at] = 0
        # the k-th accumulator bounds the k-th score from below
        floor = int(np.partition(summed.impacts, len(at) - k)[len(at) - k]) if len(at) >= k else 0
        iterators = [(summed, 1)] + [(entry.blocked(), times) for entry, times in mine if len(entry.docs) > limit]
        peaks = np.array([entry.peaks * times for entry, times in iterators])
        total = peaks.sum(axis=0)
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in range(len(total)):  # document at a time, in blocks; a block below the floor is skipped
            if total[b] < max(floor, 1):
                continue
            found, value = self._block(iterators, peaks[:, b], b, floor)
            places, scores = np.concatenate([places, found]), np.concatenate([scores, value])
            if len(places) > k:
                keep = np.lexsort((places, -scores))[:k]
                places, scores = places[keep], scores[keep]
            if len(places) == k:
                floor = max(floor, int(scores.min()))
        return places, scores

    def _block(self, iterators: list[tuple[_List, int]], peaks: np.ndarray, b: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a block that may reach the floor, with their scores."""
        order = np.argsort(peaks, kind="stable")
        rest = np.cumsum(peaks[order])  # what the lists up to each one can add together
        start, width = int(self.edges[b]), int(self.edges[b + 1] - self.edges[b])
        lazy = int(np.searchsorted(rest, floor, "left"))  # a document found in these lists alone stays below the floor
        score = np.zeros(width, np.int64)
        for i in order[lazy:]:
            docs, impacts = iterators[i][0].part(b)
            score[docs - start] += impacts * iterators[i][1]
        docs = np.flatnonzero(score)
        score, docs = score[docs], docs + start
        for j in range(lazy - 1, -1, -1):  # the other lists are only asked for documents that they could lift to the floor
            keep = score + rest[j] >= floor
            docs, score = docs[keep], score[keep]
            if not len(docs):
                break
            held, impacts = iterators[order[j]][0].part(b)
            if len(held):
                where = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                score = score + np.where(held[where] == docs, impacts[where], 0) * iterators[order[j]][1]
        self.evaluated += len(docs)
        keep = score >= max(floor, 1)
        return docs[keep], score[keep]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _searcher(queries: dict[int, list[tuple[str, int]]], weights: dict[str, int], n_docs: int, n_terms: int, k: int, cfg: SearchConfig) -> Callable:
    def run(lists: pa.Table, segment: pa.Table) -> pa.Table:
        out: dict[str, list] = {"number": [], "doc_id": [], "score": [], "place": []}
        if lists.num_rows:
            ids, sizes = segment.column("ids")[0].as_py(), np.asarray(segment.column("sizes")[0].as_py(), np.int64)
            norm = 8 * (25 + 75 * sizes * n_docs // n_terms)
            edges, known = np.append(np.arange(0, len(ids), cfg.block), len(ids)), {}
            for term, docs, tfs in zip(lists.column("term").to_pylist(), lists.column("docs"), lists.column("tfs"), strict=True):
                docs, tfs = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64)
                known[term] = _List(docs, weights[term] * (1_000_000_000 * tfs // (1000 * tfs + norm[docs])), edges)
            search = SegmentSearch(known, len(ids), cfg)
            for number, item in queries.items():
                places, scores = search.best(item, k)
                out["number"] += [number] * len(places)
                out["doc_id"] += [ids[p] for p in places]
                out["score"] += scores.tolist()
                out["place"] += places.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def _items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, number) and (number, term, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(counts), pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for t in counts], pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], names=["number", "term", "times"])

    numbered = staged(items.select("item_id").distinct().withColumn("number", F.monotonically_increasing_id()), "items")
    texts = items.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumnRenamed("item_id", "own")
    rows = texts.join(numbered, F.col("own").eqNullSafe(F.col("item_id"))).select("number", "text").mapInArrow(run, "number long, term string, times long")
    return numbered, rows.groupBy("number", "term").agg(F.sum("times").alias("times"))


def search(index: Index, items: DataFrame, k: int = 10, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, equal scores by doc_id.

    A document's score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included; w grows with a term's
    rarity and m with the document's length. Items are rows (item_id, text): equal rows are one item, and rows that share an
    item_id are one item with the terms of all. An item without a known term has no rows. Every document row is ranked, also
    repeated ones; a null doc_id comes after all others. Null and empty texts have no terms. Empty tables give no rows. Other
    columns are not read.

    In each segment the lists of an item that hold few documents are summed into accumulators (term at a time). These act as one
    list with a known maximum beside the long lists, which are passed document at a time: blocks and documents whose bounds
    stay below the k-th best score so far are skipped. Then the best of all segments are ranked. Items go in blocks
    of cfg.block_terms rows, the only data sent to the tasks whole.
    """
    spark = items.sparkSession
    totals = index.segments.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    numbered, asked = _items(items)
    asked = staged(asked, "asked")
    frequency = index.lists.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    asked = staged(asked.join(frequency, "term"), "terms")
    blocks = max(1, math.ceil(asked.count() / cfg.block_terms))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b)
        queries, weights = defaultdict(list), {}
        for r in block.select("number", "term", "times", "df").collect():  # block_terms rows, or one item
            queries[r["number"]].append((r["term"], r["times"]))
            weights[r["term"]] = weight(n_docs, r["df"])
        wanted = spark.createDataFrame([(t,) for t in weights], "term string")
        lists = index.lists.select("segment", "term", "docs", "tfs").join(F.broadcast(wanted), "term")  # block_terms rows at most
        best = lists.groupBy("segment").cogroup(index.segments.groupBy("segment")).applyInArrow(
            _searcher(dict(queries), weights, n_docs, n_terms, k, cfg), "number long, doc_id long, score long, place long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered, "number").select("item_id", "rank", "doc_id", "score")
