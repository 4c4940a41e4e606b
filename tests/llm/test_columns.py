"""Columns of the caller that clash with working names, bounds with repeated ids, context that decides."""

from pyspark.sql import functions as F

from soundquay.llm import decontaminate, pii, quality, simhash
from soundquay.llm.labelled import held_out, training_rows

from .corpora import DOCS, awkward, sentence


def clashing(df, *names):
    return df.withColumns({name: F.lit(name) for name in names})


def same_columns(out, docs, names):
    rows = out.select(*names).distinct().collect()
    return out.columns == docs.columns and [tuple(r) for r in rows] == [tuple(names)]


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    names = ("_id", "_body", "_body_", "root", "row")
    odd = clashing(docs, *names)
    out = simhash.keep_one(odd)
    assert same_columns(out, odd, names) and out.count() == simhash.keep_one(docs).count()
    names = ("_leak", "_body", "item", "passage")
    odd = clashing(docs, *names)
    items = spark.createDataFrame([(1, awkward()[7][1][:400])], "item_id long, text string")
    out = decontaminate.keep_clean(odd, items)
    assert same_columns(out, odd, names) and out.count() == decontaminate.keep_clean(docs, items).count() < docs.count()
    names = ("pii_email", "_pii_card", "pii_iban")
    odd = clashing(docs, *names)
    assert same_columns(pii.redact(odd), odd, names)


def test_statistics_of_the_caller_stay(spark):
    rows = [(i, sentence(i, 30) if i % 2 else "x " * 20, "en", "s", 1) for i in range(60)]
    docs = clashing(spark.createDataFrame(rows, DOCS), "_statistics")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = quality.scored(docs, quality.fit(docs, labels))
    assert out.columns == [*docs.columns, "score"] and out.select("_statistics").distinct().count() == 1


def test_training_rows_are_bounded_when_ids_repeat(spark):
    one = next(i for i in range(100) if not spark.range(1).select(held_out(F.lit(i))).first()[0])
    rows = [(one, f"text {i}", "en", "s", 1) for i in range(500)]
    labels = spark.createDataFrame([(one, 1, 1), (one + 1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = training_rows(docs, labels, "quality", 10)
    assert got.count() == 10
    assert sorted(map(str, got.collect())) == sorted(map(str, training_rows(docs.repartition(7), labels, "quality", 10).collect()))


def test_context_decides(spark):
    texts = ["my ssn 123-45-6789 here", "part 123-45-6789 here", "Social Security number: 078-05-1120.",
             "ssn 000-45-6789, 666-45-6789, 123-00-6789, 123-45-0000", "ssn 1123-45-6789 123-45-67890",
             "ssn 123-45-6789@example.com"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.report(docs).collect()}
    assert got[0] == ("ssn:7:18", [0.8]) and got[1] == ("", [])
    assert got[2] == ("ssn:24:35", [0.8]) and got[3] == ("", []) and got[4] == ("", [])
    assert got[5][0].startswith("email:")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "my ssn <ssn> here" and clean[1] == texts[1]
