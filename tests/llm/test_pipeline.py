"""The whole pipeline on small awkward tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from soundquay.llm import simhash

from .corpora import DOCS, awkward, sentence


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    def write(spark, rows, extra=()):
        root = str(tmp_path_factory.mktemp("sf"))
        docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in extra})
        docs.write.parquet(f"{root}/documents.parquet")
        ids = [i for i in range(1000, 1080)]
        spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        item = " ".join(sentence(1007, 60).split()[10:50])
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
        return root

    return write


def rows():
    good = [(i, sentence(i, 60) + ". Write to a@b.example.com now.", "en", "s", 1) for i in range(1001, 1080, 2)]
    bad = [(i, "$$ ## " * 30, "en", "s", 1) for i in range(1000, 1080, 2)]
    return [*awkward(), *good, *bad]


def test_pipeline_of_awkward_rows(spark, tables):
    """Null ids and texts, repeated rows, copies, and columns that clash with working names."""
    plain = tables(spark, rows())
    odd = tables(spark, rows(), ("_id", "_body", "_leak", "_score", "_before", "_statistics", "root", "size", "bucket"))
    out = corpus_pipeline.run(spark, plain)
    again = corpus_pipeline.run(spark, odd)
    assert again.columns == out.columns
    ids = sorted(r["doc_id"] for r in out.filter("doc_id is not null").collect())
    assert ids == sorted(r["doc_id"] for r in again.filter("doc_id is not null").collect())
    assert len(ids) == len(set(ids)) or ids.count(20) <= 2
    assert set(range(1001, 1080, 2)) - set(ids) == {1007}  # the leaked one goes, clean ones stay
    assert not set(range(1000, 1080, 2)) & set(ids)  # junk goes


def test_stages_keep_the_columns_and_redact(spark, tables):
    root = tables(spark, rows())
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, root).collect(), DOCS)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert "a@b.example.com" not in kept[1001]["text"] and "<email>" in kept[1001]["text"]
    assert kept[1001]["n_chars"] == len(kept[1001]["text"])


def test_pipeline_of_an_empty_table(spark, tables):
    assert corpus_pipeline.run(spark, tables(spark, [])).count() == 0


def test_near_copies_are_the_groups_of_the_fingerprints(spark, tables):
    """The stage keeps the least document of each component that op9 finds, and no other."""
    line = " ".join(f"line{i}" for i in range(35))
    same_print = [(500 + k, " ".join([line] * 40 + [f"t{k}x{i}" for i in range(104)]), "en", "s", 1) for k in range(2)]
    edited = [(600 + k, sentence(6, 400) + f" e{k}", "en", "s", 1) for k in range(4)]
    docs = spark.createDataFrame([*same_print, *edited, (700, sentence(7, 60), "en", "s", 1)], DOCS)
    want = {r["component_id"] for r in simhash.report(docs).collect()}
    assert want < {r["doc_id"] for r in docs.collect()}
    kept = corpus_pipeline.near_copies_stage(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
