"""Toxicity by compression distance: windows are compressed against an ordinary and a toxic zstandard dictionary."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import Memo, doc_crc, map_columns
from fieldspark.llm.labelled import logistic, sigmoid, training_rows


@dataclass(frozen=True)
class CompressionConfig:
    #: labelled rows of each class that dictionaries and thresholds are fitted on, at most 1.2 times as many
    rows_per_class: int = 3_000
    window: int = 2
    level: int = 9
    ordinary_bytes: int = 4096
    toxic_bytes: int = 8192
    #: a word speaks for toxic text if it stands in this many different contexts there, and e^lift times as often as elsewhere
    contexts: int = 6
    lift: float = 3.0
    #: telling passages that make up one training sample of the toxic dictionary; a single one is too short to train on
    sample: int = 8
    #: one of so many windows of ordinary text, by a hash of text and place, is a sample for the ordinary dictionaries; of each at most so many
    ordinary_share: int = 3
    ordinary_windows: int = 60_000


#: Follows each window and ends both dictionaries. The compressor looks for no match in the last bytes of its input and stores
#: a short input it can hardly shorten as it is; behind a tail that both dictionaries hold, a match of any word counts.
TAIL = bytes(range(1, 9)) + bytes(range(14, 32))
EDGES = (-1, 10)  # differences of lengths are counted from below -1 to above 10
MARKS = b".,;:!?"
WINDOWS_KEPT = 600_000  # windows of a task whose figures are kept: some 80 MB


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def windows(text: str | None, size: int) -> list[bytes]:
    """Consecutive windows of words; a last one of half a window or less is joined to the one before."""
    words = _words(text)
    starts = list(range(0, max(1, len(words) - size // 2), size))
    return [b" ".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)] if words else []


def _context_counts(texts: list[str]) -> dict[bytes, int]:
    """In how many different contexts (word before, word after) each word stands: copies of a text add nothing."""
    number: dict[bytes, int] = {}
    found = [np.empty((0, 2), np.uint64)]
    for text in texts:
        words = [w.strip(MARKS) for w in _words(text)]
        if words:
            ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
            around = np.concatenate([[0], ids[:-1] + 1]).astype(np.uint64) << np.uint64(32) | np.concatenate([ids[1:] + 1, [0]]).astype(np.uint64)
            found.append(np.stack([ids, around], axis=1))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]).any(axis=1)
    counts = np.bincount(every[new, 0].astype(np.int64), minlength=len(number))
    return dict(zip(number, counts.tolist(), strict=True))


def _chosen(samples: list[bytes], seed: int, share: int) -> list[bytes]:
    """One of `share` samples, by a hash of the seed and the place: a frequent sample stays as frequent."""
    return [s for i, s in enumerate(samples) if zlib.crc32(b"%d" % i, seed) % share == 0]


def _bounded(samples: list[bytes], most: int) -> list[bytes]:
    """At most so many samples, chosen by a hash of their places; in their order."""
    if len(samples) <= most:
        return samples
    marks = np.array([zlib.crc32(b"%d" % i) for i in range(len(samples))])
    return [samples[i] for i in np.sort(np.argsort(marks, kind="stable")[:most])]


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class CompressionModel:
    """Both dictionaries hold the same ordinary part; one goes on with toxic passages, one with as many more ordinary ones."""

    cfg: CompressionConfig
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    intercept: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor, Memo]:
        """Both compressors, and by how many bytes the toxic dictionary shortens a window: each window is compressed once."""
        def one(content: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(
                level=self.cfg.level, dict_data=zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False)

        def shortened(window: bytes) -> int:
            framed = b" " + window + b" " + TAIL
            return len(plain.compress(framed)) - len(toxic.compress(framed))

        plain, toxic = one(self.ordinary), one(self.toxic)
        return plain, toxic, Memo(shortened, WINDOWS_KEPT)

    def score(self, text: str | None, pair: tuple) -> float:
        return float(sigmoid(distances(text, pair, self.cfg) @ self.weights + self.intercept))


def distances(text: str | None, pair: tuple, cfg: CompressionConfig) -> np.ndarray:
    """How many windows the toxic dictionary shortens by how many bytes, as counts and as shares, with their number and mean."""
    known = pair[2]
    d = np.array([known[w] for w in windows(text, cfg.window)] or [0])
    h = np.bincount(np.clip(d, *EDGES) - EDGES[0], minlength=EDGES[1] - EDGES[0] + 1)
    return np.concatenate([np.log1p(h), np.sqrt(h / len(d)), [np.log(len(d)), d.mean()]])


def fit(rows: list[tuple[int, str]], cfg: CompressionConfig) -> CompressionModel:
    """Dictionaries from two thirds of the rows, calibration from the rest. Without rows of both classes: a constant score."""
    size = 2 * (EDGES[1] - EDGES[0] + 1) + 2
    classes = {label for label, _ in rows}
    if classes != {0, 1}:
        return CompressionModel(cfg, b"ordinary" * 8, b"toxic   " * 8, np.zeros(size), {(0,): -3.0, (1,): 3.0}.get(tuple(classes), 0.0))
    third = [zlib.crc32(text.encode("utf-8", "replace")) % 3 == 0 for _, text in rows]
    toxic = [t for (label, t), c in zip(rows, third, strict=True) if label and not c]
    plain = [t for (label, t), c in zip(rows, third, strict=True) if not label and not c]
    a, b = _context_counts(toxic), _context_counts(plain)
    na, nb = sum(a.values()) or 1, sum(b.values()) or 1
    telling = {w for w, n in a.items() if n >= cfg.contexts and np.log((n + 0.5) / na) - np.log((b.get(w, 0) + 0.5) / nb) > cfg.lift}
    passages = [b" " + w.strip(MARKS) + b" " for t in toxic for w in _words(t) if w.strip(MARKS) in telling]
    passages = passages or [w for t in toxic for w in windows(t, 5)] or [b"toxic"]
    common = [w for t in plain for w in _chosen(windows(t, 5), zlib.crc32(t.encode("utf-8", "replace")), cfg.ordinary_share)] or [b"ordinary"]
    half = max(1, 2 * len(common) // 3)
    base = _trained(_bounded(common[:half], cfg.ordinary_windows), cfg.ordinary_bytes, 64, 6)
    samples = [b"".join(passages[i : i + cfg.sample]) for i in range(0, len(passages), cfg.sample)]
    extra = _trained(samples, cfg.toxic_bytes, 32, 8)
    same = _trained(_bounded(common[half:] or common, cfg.ordinary_windows), max(256, len(extra)), 16, 8)
    model = CompressionModel(cfg, base + same, base + extra, np.zeros(size), 0.0)
    pair = model.compressors()
    held = [r for r, c in zip(rows, third, strict=True) if c] or rows
    y = np.array([label for label, _ in held], float)
    if y.min() == y.max():
        held, y = rows, np.array([label for label, _ in rows], float)
    x = np.array([distances(t, pair, cfg) for _, t in held])
    model.weights, model.intercept = logistic(x, y)
    return model


def prior(model: CompressionModel, sampled: float, actual: float) -> CompressionModel:
    """Move the intercept from the share of toxic rows in the sample to the share among all labels."""
    if 0 < sampled < 1 and 0 < actual < 1:
        model.intercept += float(np.log(actual / (1 - actual)) - np.log(sampled / (1 - sampled)))
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, cfg: CompressionConfig = CompressionConfig()) -> CompressionModel:
    rows = training_rows(docs, labels, "toxic", folds, held_out, cfg.rows_per_class)
    got = [(r["label"], r["text"]) for r in rows.select("label", "text").collect() if r["text"]]
    got.sort(key=lambda r: (zlib.crc32(r[1].encode("utf-8", "replace")), r[1], r[0]))
    model = fit(got, cfg)
    share = labels.where(F.col("toxic").isin(0, 1) & (doc_crc(F.col("doc_id"), folds) != held_out)).agg(F.avg("toxic")).first()[0]
    return prior(model, sum(label for label, _ in got) / max(1, len(got)), share or 0.0)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score), one row per document row; whole texts. A null or empty text has no window and one fixed low score."""
    def run(batch: pa.RecordBatch, pair: tuple) -> dict:
        return {"doc_id": batch.column(0), "score": np.array([model.score(t.as_py(), pair) for t in batch.column(1)], float)}

    kind = dict(docs.dtypes)["doc_id"]
    return map_columns(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, score double", model.compressors)
