"""From documents to packed training sequences: language ID, line dedup, near-dedup, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import ecoc_language, line_runs, simhash_mih, source_mix, ss_packing
from fieldspark.llm.common import staged
from fieldspark.llm.queries import packing_config


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without a letter or between two languages go."""
    model = ecoc_language.train(docs, 4, 2)
    return ecoc_language.identify_rows(docs, model).where("lang_pred <> 'und' AND NOT ambiguous").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line stays in the smallest document only; n_chars, if there is one, follows the text."""
    own = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col(f"`{c}`") for c in own]).alias("rest")
    rows = line_runs.dedup_lines(docs.select("doc_id", "text", rest))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        value = F.col("rest")[c]
        if c == "n_chars":
            value = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(value)
        return value.alias(c)

    return rows.select(*[column(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_mih.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: a document that is taken twice is there twice."""
    return source_mix.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ss_packing.pack_documents(docs, packing_config())


STAGES = [
    ("language ID", identified),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("source mix", mixed),
    ("packing", packed),
]

#: SQL has neither the classifiers nor XXH64 nor the tokenizer; README.md says what tests hold the stages against.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage{i}")
    return docs
