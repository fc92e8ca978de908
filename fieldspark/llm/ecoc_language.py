"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldspark.llm.common import doc_crc, map_columns
from fieldspark.llm.labelled import Adam, sigmoid


@dataclass(frozen=True)
class EcocConfig:
    #: rows that the classifiers are fitted on, over all languages together, at most 1.2 times as many
    rows: int = 2_000
    pair_buckets: int = 1024
    triple_buckets: int = 4096
    #: bits of a random code for many languages: this many times log2 of their number
    bits: int = 15
    steps: int = 150
    #: a document is ambiguous if its second codeword is nearer to the first than this share of the weighted loss
    margin: float = 0.02
    seed: int = 5

    @property
    def size(self) -> int:
        return 256 + self.pair_buckets + self.triple_buckets


LETTER = regex.compile(r"\p{L}")
#: bytes as the n-grams see them: A-Z in lower case, other ASCII that is no letter as a space
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BLOCK = 1 << 20


def counts(text: str, cfg: EcocConfig) -> np.ndarray:
    """Hashed counts of bytes, pairs and triples of the whole text, block by block."""
    raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
    total = np.zeros(cfg.size)
    for at in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw[max(0, at - 2) : at + BLOCK], np.uint8).astype(np.uint32)
        pair = (b[:-1] << np.uint32(8)) | b[1:]
        triple = ((pair[:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
        total[:256] += np.bincount(b, minlength=256)
        total[256 : 256 + cfg.pair_buckets] += np.bincount((pair * np.uint32(40503) >> np.uint32(6)) % cfg.pair_buckets, minlength=cfg.pair_buckets)
        total[256 + cfg.pair_buckets :] += np.bincount((triple >> np.uint32(12)) % cfg.triple_buckets, minlength=cfg.triple_buckets)
    return total


def features(text: str, cfg: EcocConfig) -> np.ndarray:
    """Square roots of the shares: vectors of one length, whatever the text's."""
    n = counts(text, cfg)
    return np.sqrt(n / max(1.0, n.sum())).astype(np.float32)


def codewords(languages: int, cfg: EcocConfig) -> np.ndarray:
    """Rows of -1 and 1, one for each language: all splits into two sides up to 5 languages, else the best of random codes."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 5:
        width = (1 << (languages - 1)) - 1
        return np.array([[1 if lang == 0 or (split >> (lang - 1)) & 1 else -1 for split in range(width)] for lang in range(languages)], np.int8)
    rng, width, best = np.random.default_rng(cfg.seed), int(np.ceil(cfg.bits * np.log2(languages))), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, width))
        apart = min((code[i] != code[j]).sum() for i in range(languages) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class EcocModel:
    cfg: EcocConfig
    languages: list[str]
    code: np.ndarray
    w: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[int, float, float]:
        """(nearest language, its score, margin): the loss of each bit weighs as much as its classifier was right in fitting."""
        if len(self.languages) == 1:
            return 0, 1.0, 1.0
        z = x @ self.w + self.bias
        loss = (np.logaddexp(0, -self.code * z) * self.trust).sum(axis=1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss[order[0]]) * len(z))
        return int(order[0]), float(1 / p.sum()), float((loss[order[1]] - loss[order[0]]) / max(1e-9, loss[order[1]]))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous); ("und", 0, True) if the text is null or has no letter, or nothing was learned."""
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        best, score, margin = self.decode(features(text, self.cfg))
        return self.languages[best], score, margin < self.cfg.margin


def fit(rows: list[tuple[str, bytes]], cfg: EcocConfig) -> EcocModel:
    """One logistic classifier for each bit, all fitted together on half-precision feature vectors; languages weigh alike."""
    languages = sorted({lang for lang, _ in rows})
    code = codewords(len(languages), cfg)
    w, bias = np.zeros((cfg.size, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if code.shape[1] == 0:
        return EcocModel(cfg, languages, code, w, bias, np.ones(0))
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[lang] for lang, _ in rows])
    x = np.empty((len(rows), cfg.size), np.float32)
    for i, (_, raw) in enumerate(rows):
        x[i] = np.frombuffer(raw, np.float16)
    weight = (1.0 / np.bincount(y))[y][:, None].astype(np.float32) / len(languages)
    target = (code[y] > 0).astype(np.float32)
    adam, adam_bias = Adam(w, 0.2), Adam(bias, 0.2)
    for _ in range(cfg.steps):
        error = (sigmoid(x @ w + bias).astype(np.float32) - target) * weight
        w -= adam.step(x.T @ error + 1e-6 * w)
        bias -= adam_bias.step(error.sum(axis=0))
    right = (((x @ w + bias) > 0) == (target > 0)) * weight
    return EcocModel(cfg, languages, code, w, bias, np.maximum(0.01, 2 * right.sum(axis=0) - 1))


def train(docs: DataFrame, folds: int, held_out: int, cfg: EcocConfig = EcocConfig()) -> EcocModel:
    """Fitted on a sample of documents with a language and a letter, outside the held-out fold; as many rows of each language
    as there are, up to its equal part of cfg.rows."""
    docs = docs.select("doc_id", "lang", "text")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_crc(F.col("doc_id"), folds) != held_out))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return fit([], cfg)
    each = max(1, cfg.rows // len(sizes))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, each / v)) for k, v in sizes.items()], "lang string, share double")
    hashed = F.pmod(F.xxhash64(F.lit(cfg.seed), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = known.join(F.broadcast(shares), "lang").where(hashed < F.col("share")).select(
        F.col("lang").cast("string"), F.col("text").cast("string").alias("text")).limit(int(1.2 * cfg.rows) + len(sizes))

    def run(batch: pa.RecordBatch) -> dict:
        kept = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if LETTER.search(t)]
        return {"lang": [k for k, _ in kept], "x": [features(t, cfg).astype(np.float16).tobytes() for _, t in kept]}

    got = map_columns(rows, run, "lang string, x binary").collect()
    got.sort(key=lambda r: (zlib.crc32(bytes(r["x"])), r["lang"]))
    return fit([(r["lang"], r["x"]) for r in got], cfg)


def identify_rows(docs: DataFrame, model: EcocModel) -> DataFrame:
    """(row, lang_pred, score, ambiguous): `row` is a struct of all columns of docs, whatever their names; one row per document
    row; whole texts, nothing but the text."""
    def run(batch: pa.RecordBatch) -> dict:
        found = [model.predict(t.as_py()) for t in batch.column(0)]
        return {"row": batch.column(1), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "ambiguous": [f[2] for f in found]}

    given = docs.select(F.col("text").cast("string").alias("_text"), F.struct("*").alias("row"))
    schema = StructType([given.schema["row"], *StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields])
    return map_columns(given, run, schema)


def identify(docs: DataFrame, model: EcocModel, *carry: str) -> DataFrame:
    """The carried columns with lang_pred, score and ambiguous. Carried columns of these names give way; see identify_rows."""
    own = [c for c in carry if c not in ("lang_pred", "score", "ambiguous")]
    rows = identify_rows(docs.select("text", *[F.col(f"`{c}`") for c in own if c != "text"]), model)
    return rows.select(*[F.col("row")[c].alias(c) for c in own], "lang_pred", "score", "ambiguous")
