"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes what its predecessor kept, from Parquet, and all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundquay.llm import decontaminate, packing, pii, quality, simhash
from soundquay.llm.tables import Staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rule ensemble scores as good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model, "_score")
    return scored.filter(F.col("_score") >= quality.LEAST_SCORE).select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, linked by their SimHash fingerprints as in op9."""
    return simhash.keep_one(docs, simhash.print_groups).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a test item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    length = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    clean = pii.redact(docs.withColumn("_before", F.col("text")))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of the documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

#: trained models and alignments have no SQL form; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = Staged(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return work.keep(stage(spark, docs, sf_dir), name)
