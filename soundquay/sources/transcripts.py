"""Transcript indexes of speech collections and their join with audio files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(list(paths))


def parse_tab_index(lines: DataFrame) -> DataFrame:
    """``file_id <tab> ... <tab> transcript``: first and last non-empty field."""
    fields = F.filter(
        F.transform(F.split("value", "\t"), lambda p: F.trim(p)), lambda p: p != ""
    )
    return (
        lines.select(fields.alias("_f"))
        .filter(F.size("_f") >= 2)
        .select(F.col("_f")[0].alias("file_id"), F.element_at("_f", -1).alias("text"))
    )


def parse_word_index(lines: DataFrame) -> DataFrame:
    """``file_id words ...``: split on the first blank, both parts required."""
    return (
        lines.select(
            F.regexp_extract("value", r"^(\S+) (.+)$", 1).alias("file_id"),
            F.trim(F.regexp_extract("value", r"^(\S+) (.+)$", 2)).alias("text"),
        )
        .filter(F.col("file_id") != "")
    )


def read_tab_index(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_tab_index(_lines(spark, *paths))


def read_word_index(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_word_index(_lines(spark, *paths))


def list_audio(spark: SparkSession, root: str, glob: str = "*.{wav,flac}") -> DataFrame:
    """Names and sizes of audio files. Only metadata columns are read, never the content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "modificationTime", "length")
    )


def join_transcripts(files: DataFrame, index: DataFrame) -> DataFrame:
    """Audio files that have a transcript, matched on the name without its ending."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.withColumn("file_id", stem).join(index, "file_id")
