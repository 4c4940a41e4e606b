"""Training rows for classifiers: a bounded sample of labelled documents outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of the training folds: texts with a label (0.0 or 1.0).

    The sample is the labelled documents with the smallest hashes of their ids, so it does not
    depend on the order of rows. Its ids are at most max_rows numbers of 8 bytes: that bound lets
    the join broadcast them, and the documents are not shuffled. Where ids repeat, the rows with
    the smallest hashes of id and text stay. A document with several labels takes the largest;
    null labels and null ids are left out.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = texts.join(F.broadcast(ids), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(max_rows)
