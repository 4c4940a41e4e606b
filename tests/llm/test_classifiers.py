"""Classifiers by held-out accuracy, and the pipeline by its stages."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from soundquay.llm import quality, toxicity
from soundquay.llm.labelled import training_rows
from soundquay.llm.queries import QUERIES

from .corpora import DOCS, awkward

LARGER = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def _auc(labels, scores):
    good, bad = scores[labels == 1], scores[labels == 0]
    return (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2


@pytest.mark.parametrize(("name", "label", "limit", "least"), [("op8_quality", "quality", 0.3, 0.97),
                                                              ("op5_toxicity", "toxic", 0.5, 0.85)])
def test_held_out_accuracy(spark, name, label, limit, least):
    out = QUERIES[name](spark, LARGER).toPandas()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    assert len(out) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(h == (crc32(str(d).encode()) % 5 == 0) for d, h in zip(out.doc_id, out.held_out))
    assert out.score.between(0, 1).all() and ((out.score >= limit) == (out.predicted == 1)).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert _auc(held[label].to_numpy(), held.score.to_numpy()) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module):
    docs = spark.createDataFrame(awkward(), DOCS).withColumn("label", F.lit("x")).withColumn("_statistics", F.lit(1))
    labels = spark.createDataFrame([(i * 10, i % 2, i % 3 == 0 and 1 or 0) for i in range(12)] + [(None, 1, 1), (5, None, None)],
                                   LABELS)
    out = module.score_documents(docs, labels)
    assert out.count() == docs.count() and out.filter("score is null").count() == 0
    assert module.score_documents(docs.limit(0), labels).count() == 0
    even = module.score_documents(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(even) == 1 and even[0]["score"] == pytest.approx(0.5)


def test_training_rows_are_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(500)] * 2, LABELS)
    rows = training_rows(docs, labels, "quality", 50).collect()
    assert len(rows) == 50 and all(crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_paths_of_a_printed_tree():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 3 <= 0.5)
   If (feature 1 <= -2.0E-1)
    Predict: 0.0
   Else (feature 1 > -2.0E-1)
    Predict: 1.0
  Else (feature 3 > 0.5)
   Predict: 0.0
"""
    assert quality.paths(tree) == [
        ((3, "<=", 0.5),), ((3, "<=", 0.5), (1, "<=", -0.2)), ((3, "<=", 0.5), (1, ">", -0.2)), ((3, ">", 0.5),)]


def test_rules_compile_to_columns(spark):
    model = quality.Model(((((0, "<=", 1.0), (1, ">", 2.0)), 1.5), (((1, "<=", 2.0),), -0.5)), 0.25)
    rows = [([0.5, 3.0], 1.75), ([0.5, 1.0], -0.25), ([2.0, 3.0], 0.25)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "at array<double>").select(model.score(F.col("at")).alias("p"))
    assert [r["p"] for r in df.collect()] == pytest.approx([1 / (1 + np.exp(-z)) for _, z in rows])


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert tuple(after.columns) == corpus_pipeline.COLUMNS
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        had = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= had and len(ids) == after.count()
        if name == "quality":
            good = set(labels[labels.quality == 1].doc_id) & had
            assert len(good & ids) > 0.9 * len(good)
        if name == "near_copies":
            texts = [r["text"] for r in after.select("text").collect()]
            assert len(texts) == len(set(texts))
            assert set(texts) <= {r["text"] for r in before.select("text").collect()}
        before = after
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
