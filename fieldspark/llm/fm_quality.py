"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import Memo, map_columns, words_of
from fieldspark.llm.labelled import sigmoid, training_rows


@dataclass(frozen=True)
class FmConfig:
    #: labelled rows of each class that the model is fitted on, at most 1.2 times as many
    rows_per_class: int = 5_000
    word_buckets: int = 1 << 15
    rank: int = 8
    epochs: int = 6
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 1


UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]\\^~=_@"
STATS = ("bias", "log_words", "word_bytes", "upper", "digits", "marks", "exclaims", "bars", "distinct", "top_word", "stutter", "line_repeats",
         "lines", "stops", "non_ascii", "log_declared", "no_declared", "declared_gap")


def features(text: str | None, n_chars: int | None, buckets: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero features: structure statistics and metadata first, then hashed words."""
    words, raw = words_of(text), (text or "").encode("utf-8", "surrogatepass")
    n, size = max(1, len(words)), max(1, len(raw))
    ids, counts = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int32, len(words)), return_counts=True)
    tf = np.log1p(counts)
    norm = float(np.sqrt((tf * tf).sum())) or 1.0
    lines = raw.split(b"\n")
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    stats = (
        1.0, np.log1p(len(words)) / 10, sum(map(len, words)) / n / 10, share(UPPER), share(DIGITS), share(MARKS) * 5, raw.count(b"!") / n,
        raw.count(b"|") / n, len(ids) / n, counts.max(initial=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines), len(lines) / n, (raw.count(b".") + raw.count(b",")) / n, 1 - len(text or '') / size if raw else 0.0,
        np.log1p(max(0, n_chars or 0)) / 15, float(n_chars is None), min(1.0, abs(len(text or "") - (n_chars or 0)) / size))
    return (np.concatenate([np.arange(len(STATS), dtype=np.int32), ids + len(STATS)]),
            np.concatenate([np.array(stats, np.float32), (tf / norm).astype(np.float32)]))


def bucket_memo(cfg: FmConfig) -> Memo:
    return Memo(lambda w: zlib.crc32(w) % cfg.word_buckets, 500_000)


@dataclass
class FmModel:
    """y = sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairs in time linear in the features."""

    cfg: FmConfig
    w: np.ndarray
    v: np.ndarray

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.v[ids]
        sums = x @ v
        return float(self.w[ids] @ x + 0.5 * (sums @ sums - ((v * v).T @ (x * x)).sum()))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], cfg: FmConfig) -> FmModel:
    """Mini-batches with adaptive steps over (label, ids, values). Without rows of both classes the model is constant."""
    rng, size = np.random.default_rng(cfg.seed), len(STATS) + cfg.word_buckets
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, cfg.rank))
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        if len(y):
            w[0] = 3.0 if y[0] else -3.0
        return FmModel(cfg, w, np.zeros_like(v))
    gw, gv = np.full(size, 1e-6), np.full((size, cfg.rank), 1e-6)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(cfg.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), cfg.batch):
            own = order[at : at + cfg.batch]
            ids, x = np.concatenate([rows[i][1] for i in own]), np.concatenate([rows[i][2] for i in own]).astype(float)
            sizes = np.array([len(rows[i][1]) for i in own])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[ids] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            z = np.add.reduceat(w[ids] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            error = np.repeat((sigmoid(z) - y[own]) * weight[own] / len(own), sizes) * x
            used, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, error, len(used)) + cfg.decay * w[used]
            pull = error[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(cfg.rank)], axis=1) + cfg.decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= cfg.rate * dw / np.sqrt(gw[used])
            v[used] -= cfg.rate * dv / np.sqrt(gv[used])
    return FmModel(cfg, w.astype(np.float32), v.astype(np.float32))


def _declared(docs: DataFrame) -> Column:
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, cfg: FmConfig = FmConfig()) -> FmModel:
    """Features of a bounded labelled sample are made by Spark; the sample's feature vectors are fitted on the driver."""
    rows = training_rows(docs, labels, "quality", folds, held_out, cfg.rows_per_class, _declared(docs))

    def run(batch: pa.RecordBatch, buckets: Memo) -> dict:
        found = [features(t, n, buckets) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return {"id": [str(i) for i in batch.column(0).to_pylist()], "label": batch.column(3), "ids": [i.tobytes() for i, _ in found],
                "x": [x.tobytes() for _, x in found]}

    got = map_columns(rows, run, "id string, label int, ids binary, x binary", lambda: bucket_memo(cfg)).collect()
    got.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["x"]))  # the same order on every run
    return fit([(r["label"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got], cfg)


def score(docs: DataFrame, model: FmModel) -> DataFrame:
    """(doc_id, score), one row per document row; whole texts. Null and empty texts are scored by their statistics alone."""
    def run(batch: pa.RecordBatch, buckets: Memo) -> dict:
        z = [model.margin(*features(t.as_py(), n.as_py(), buckets)) for t, n in zip(batch.column(1), batch.column(2), strict=True)]
        return {"doc_id": batch.column(0), "score": sigmoid(np.array(z, float))}

    kind = dict(docs.dtypes)["doc_id"]
    return map_columns(docs.select("doc_id", F.col("text").cast("string").alias("text"), _declared(docs)), run, f"doc_id {kind}, score double", lambda: bucket_memo(model.cfg))
