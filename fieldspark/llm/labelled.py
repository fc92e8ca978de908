"""Labelled training rows: bounded samples without the held-out fold, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import bounded, doc_crc, staged


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, *more: Column) -> DataFrame:
    """(doc_id, text, more.., label): about `rows` rows per class, never more than 1.2 times as many, none of the held-out fold.

    First ids are sampled, then the rows that carry them; rows that agree in id and text are one. The sampled ids are broadcast
    (2.4 times `rows` at most), so the documents are read once, and what is found is written to the shared folder. Labels other
    than 0 and 1 and null ids are left out; an id labelled twice takes its larger label. Other columns are not read.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id"), folds) != held_out)).groupBy(
        F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("label"))
    parts = [bounded(known.where(F.col("label") == v), rows, [F.col("id")]) for v in (0, 1)]
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)
    found = own.join(F.broadcast(parts[0].unionByName(parts[1])), F.col("doc_id") == F.col("id")).drop("id")
    once = staged(found.groupBy("doc_id", "label", F.xxhash64("text").alias("hash")).agg(F.min(F.struct("text", *own.columns[2:])).alias("row")), "sample")
    kept = [bounded(once.where(F.col("label") == v), rows, [F.col("doc_id"), F.col("hash")]) for v in (0, 1)]
    return kept[0].unionByName(kept[1]).select("doc_id", "row.*", "label")


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Step sizes of one parameter array."""

    def __init__(self, like: np.ndarray, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros_like(like), np.zeros_like(like), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept on the features as given; fitted on standardised ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, w = (x - mean) / scale, np.zeros(x.shape[1] + 1)
    adam = Adam(w, rate)
    for _ in range(steps):
        error = (sigmoid(z @ w[:-1] + w[-1]) - y) / len(y)
        w -= adam.step(np.append(z.T @ error + decay * w[:-1], error.sum()))
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())
