"""Columns named like those the operators use themselves, and dotted ones, pass every operator and stage unchanged."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import ecoc_language, fm_quality, labelled, line_runs, simhash_mih, source_mix, zstd_toxicity

NAMES = ["_id", "_label", "share", "_h", "a.b", "score", "ambiguous", "lang_pred", "n_lines", "n_dropped", "label", "row", "hash", "id", "th", "rest", "masks", "order", "d", "h"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    pool = {"en": [f"the{i}word" for i in range(60)], "fr": [f"élan{i}mot" for i in range(60)]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join(r.choices(pool[lang], k=60)) + f"\nthe same line everywhere\nown {i}", lang, f"s{i % 3}", 7))
    rows += [rows[5], (5, rows[5][1], "en", "other", 7), (5, None, "en", "s1", None), (100, rows[7][1], "en", "s1", 7)]
    return spark.createDataFrame([(*x, *[f"{n}{x[0]}" for n in NAMES]) for x in rows], DDL)


def unchanged(df):
    assert df.columns == [f.split()[0].strip("`") for f in DDL.split(", ")]
    for row in df.collect():
        assert all(row[n] == f"{n}{row['doc_id']}" for n in NAMES)


def test_operators(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    assert fm_quality.score(docs, fm_quality.train(docs, labels, 3, 1, fm_quality.FmConfig(epochs=1))).count() == 64
    assert zstd_toxicity.score(docs, zstd_toxicity.train(docs, labels, 4, 2)).count() == 64
    model = ecoc_language.train(docs, 4, 2)
    unchanged(ecoc_language.identify_rows(docs, model).select("row.*"))
    assert ecoc_language.identify(docs, model, "doc_id", "score", "a.b").columns == ["doc_id", "a.b", "lang_pred", "score", "ambiguous"]
    unchanged(simhash_mih.keep_one(docs))
    unchanged(source_mix.mixed_documents(docs))
    lines = line_runs.dedup_lines(docs)
    assert lines.columns == [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert all(x["a.b"] == f"a.b{x['doc_id']}" for x in lines.collect())


def test_stages(spark, docs):
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        unchanged(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() > 0
    assert corpus_pipeline.without_repeated_lines(spark, docs.drop("n_chars"), "").count() == 64


def test_of_equal_ids_and_texts_the_same_row_stays(docs):
    kept = {simhash_mih.keep_one(docs.repartition(n)).where("doc_id = 5").select("source").first()[0] for n in (1, 3, 7)}
    assert len(kept) == 1


def test_training_rows_are_bounded_not_ids(spark):
    many = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2000).alias("text"))
    some = spark.range(200).select("id", F.concat(F.lit("other "), "id").alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = labelled.training_rows(many.unionByName(some.withColumnRenamed("id", "doc_id")), labels, "quality", 3, 7, 50)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert 20 <= counts[1] <= 60 and 20 <= counts[0] <= 60
    again = spark.range(1000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    assert labelled.training_rows(again, labels, "quality", 3, 7, 5000).count() == 1
