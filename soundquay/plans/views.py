"""Speech-analytics views over the general test tables.

Each view is a list of portable column expressions over one table, so the same definition gives
a DataFrame here and a common table expression for an SQL engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundquay.functions.text import raw_words

WINDOW_WORDS = 24


@dataclass(frozen=True)
class View:
    table: str
    columns: dict[str, str]
    where: str | None = None
    distinct: bool = field(default=False)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.table)
        if self.where:
            df = df.where(self.where)
        df = df.selectExpr(*[f"{expr} AS {name}" for name, expr in self.columns.items()])
        return df.distinct() if self.distinct else df

    def sql(self) -> str:
        cols = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        distinct = "DISTINCT " if self.distinct else ""
        return f"SELECT {distinct}{cols} FROM {self.table}{where}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a small input to all cores before heavy per-row work.

    A table of one small file arrives as one task. Anything with at least as many splits as
    there are cores, so every table of a size that matters, is left as it is: no shuffle there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


VIEWS: dict[str, View] = {
    # utterance manifest, one row per Spanish or English document
    "v_utt": View(
        "documents",
        {
            "utterance_id": "'cl-' || lang || '-' || lpad(CAST(doc_id AS STRING), 9, '0')",
            "doc_id": "doc_id",
            "lang": "lang",
            "text": "text",
            "duration_s": "CAST(n_chars AS DOUBLE) / 15",
            "source": "source",
            "accent": "lang || '-' || CAST(doc_id % 3 AS STRING)",
            "speaker": "source || '_' || CAST(doc_id % 10 AS STRING)",
            "path": "source || '/' || CAST(doc_id AS STRING) || '.wav'",
        },
        where="lang IN ('es', 'en')",
    ),
    # the same for every language: input of contract checks
    "v_any": View(
        "documents",
        {
            "utterance_id": "'cl-' || lang || '-' || lpad(CAST(doc_id AS STRING), 9, '0')",
            "lang": "lang",
            "text": "CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END",
            "duration_s": "CASE WHEN doc_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) "
            "WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) / 15 END",
            "source": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END",
        },
    ),
    # scored utterances with noise codes
    "v_rec": View(
        "lineitem",
        {
            "l_orderkey": "l_orderkey",
            "l_linenumber": "l_linenumber",
            "lang": "CASE l_linestatus WHEN 'F' THEN 'es' ELSE 'en' END",
            "noise_subtype": "CASE l_suppkey % 8 WHEN 1 THEN 'AA' WHEN 2 THEN 'AB' "
            "WHEN 3 THEN 'AC' WHEN 4 THEN 'BA' WHEN 5 THEN 'BB' WHEN 6 THEN 'BC' "
            "WHEN 7 THEN 'CA' END",
            "noise_level": "CASE WHEN l_suppkey % 8 = 0 THEN NULL WHEN l_linenumber % 3 = 0 "
            "THEN '05' WHEN l_linenumber % 3 = 1 THEN '10' ELSE '15' END",
            "ref_words": "CAST(l_quantity AS BIGINT)",
            "word_edits": "CAST(floor(CAST(l_quantity AS BIGINT) * "
            "CAST(round(l_discount * 100) AS BIGINT) * (1 + l_suppkey % 8) / 100.0) AS BIGINT)",
            "n_keywords": "CAST(1 + l_partkey % 4 AS BIGINT)",
            "n_recovered": "CAST(floor((1 + l_partkey % 4) * (10 - l_suppkey % 8) / 10.0) "
            "AS BIGINT)",
            "hallucinated": "CAST(CASE WHEN l_returnflag = 'R' AND l_suppkey % 8 > 4 THEN 1 "
            "ELSE 0 END AS BIGINT)",
            "avg_logprob": "-(l_tax * 10)",
            "duration_s": "l_quantity / 4",
        },
    ),
    # telemetry
    "v_tel": View(
        "events",
        {
            "trace_id": "event_id",
            "ts": "ts",
            "store_id": "'store-' || CAST(user_id % 8 AS STRING)",
            "speech_ratio": "CAST(event_id % 100 AS DOUBLE) / 100",
            "noise_pred": "CASE event_type WHEN 'click' THEN 'AA' WHEN 'error' THEN 'BB' "
            "WHEN 'purchase' THEN 'CA' WHEN 'signup' THEN 'BC' END",
            "avg_logprob": "-(value / 100.0)",
            "guarded": "CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END",
            "rule_fired": "CASE WHEN event_id % 7 = 0 THEN 'es-0001' WHEN event_id % 11 = 0 "
            "THEN 'en-0003' END",
            "total_ms": "value * 10",
            "n_rules": "CAST(user_id % 4 AS BIGINT)",
        },
    ),
    # judge verdicts
    "v_verdict": View(
        "labels",
        {
            "transcription_id": "doc_id",
            "verdict": "CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 "
            "THEN 'minor_errors' WHEN toxic = 0 THEN 'wrong' ELSE 'hallucination' END",
            "corrected_reference": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' "
            "ELSE 'ref-' || CAST(doc_id AS STRING) END",
            "order_core_match": "doc_id % 4 <> 0",
            "confidence": "CAST(doc_id % 50 AS DOUBLE) / 50",
        },
    ),
    # per-utterance results under each mitigation chain
    "v_chain": View(
        "lineitem",
        {
            "lang": "CASE l_linestatus WHEN 'F' THEN 'es' ELSE 'en' END",
            "subtype": "CASE l_suppkey % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'BB' WHEN 2 THEN 'CA' "
            "ELSE '__clean__' END",
            "level": "CASE WHEN l_suppkey % 4 = 3 THEN NULL WHEN l_linenumber % 2 = 0 THEN '05' "
            "ELSE '15' END",
            "chain": "CASE l_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'spectral_gate' "
            "WHEN 2 THEN 'deepfilternet' ELSE 'demucs_vocals' END",
            "chain_order": "CAST(l_partkey % 4 AS BIGINT)",
            # AA gains from one chain, BB from a slow one, CA loses keywords
            "wer": "l_discount * CASE WHEN l_partkey % 4 = 0 THEN 5 WHEN l_partkey % 4 = 1 THEN 4 "
            "ELSE 3 END",
            "ker": "l_tax * CASE WHEN l_suppkey % 4 = 2 AND l_partkey % 4 > 0 THEN 6 ELSE 4 END",
            "latency_ms": "l_quantity * CASE WHEN l_suppkey % 4 = 1 AND l_partkey % 4 = 2 "
            "THEN 30 ELSE 8 END",
            "ref_words": "CAST(l_quantity AS BIGINT)",
            "word_edits": "CAST(floor(l_quantity * l_discount * (5 - l_partkey % 4)) AS BIGINT)",
            "n_keywords": "CAST(1 + l_partkey % 4 AS BIGINT)",
            "n_recovered": "CAST(l_partkey % 4 AS BIGINT)",
            "hallucinated": "CAST(0 AS BIGINT)",
        },
    ),
    # menu terms with a damaged spelling
    "v_term": View(
        "part",
        {"term": "p_name", "corrupted": "substr(p_name, 1, 2) || substr(p_name, 4)"},
        distinct=True,
    ),
    # menu rows in menu order, with spellings that differ by case only
    "v_menu": View(
        "part",
        {
            "lang": "CASE WHEN p_partkey % 2 = 0 THEN 'es' ELSE 'en' END",
            "ord": "p_partkey",
            "term": "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END",
            "canonical": "p_name",
        },
    ),
    # signals, logits, noise bank
    "v_sig": View(
        "embeddings",
        {
            "vec_id": "vec_id",
            "x": "embedding",
            "label": "label",
            "subtype": "CASE WHEN label >= 7 THEN 'CLEAN' ELSE "
            "substr('AAABACBABBBCCA', CAST(label AS INT) * 2 + 1, 2) END",
            "recording_id": "'rec-' || CAST(vec_id % 50 AS STRING)",
            "split": "CASE WHEN vec_id % 50 < 15 THEN 'eval' ELSE 'train' END",
        },
    ),
    "v_bank": View(
        "embeddings",
        {
            "clip_id": "'nz-' || lpad(CAST(vec_id AS STRING), 9, '0')",
            "vec_id": "vec_id",
            "subtype": "CASE WHEN label >= 7 THEN 'ZZ' ELSE "
            "substr('AAABACBABBBCCA', CAST(label AS INT) * 2 + 1, 2) END",
            "duration_s": "CAST(vec_id % 40 AS DOUBLE) / 4",
            "license": "CASE WHEN vec_id % 9 = 0 THEN '' ELSE 'CC-BY' END",
            "split": "CASE WHEN vec_id % 50 < 15 THEN 'eval' ELSE 'train' END",
            "recording_id": "'rec-' || CAST(vec_id % 35 AS STRING)",
        },
    ),
    "v_ticket": View(
        "orders",
        {
            "order_id": "CAST(o_orderkey AS STRING)",
            "store_id": "'store-' || CAST(o_custkey % 8 AS STRING)",
            "items": "o_orderpriority",
            "created_at": "o_orderdate",
        },
    ),
    # noise mixes: what was wanted and what came out
    "v_mix": View(
        "lineitem",
        {
            "utterance_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
            " || '-' || CAST(l_partkey AS STRING)",
            "noise_subtype": "CASE WHEN l_partkey % 10 < 3 THEN NULL ELSE 'AA' END",
            "noise_clip_id": "CASE WHEN l_partkey % 10 < 3 THEN NULL ELSE "
            "'nz-' || lpad(CAST(l_partkey % 500 AS STRING), 9, '0') END",
            "snr_db_target": "CASE WHEN l_partkey % 10 < 3 THEN NULL WHEN l_linenumber % 3 = 0 "
            "THEN 10.0 + l_tax * 10 WHEN l_linenumber % 3 = 1 THEN l_tax * 10 ELSE -4.0 END",
            "snr_db_achieved": "CASE WHEN l_partkey % 10 < 3 THEN NULL WHEN l_quantity = 1 "
            "THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber % 3 = 0 "
            "THEN 10.0 + l_tax * 10 + l_discount * 10 - 0.33 WHEN l_linenumber % 3 = 1 "
            "THEN l_tax * 10 + l_discount * 10 - 0.33 ELSE -4.0 + l_discount * 10 - 0.33 END",
        },
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name].frame(spark, sf_dir)


# --- views that need array work; the SQL twins stand in ``sqltext`` ---


def raw_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_seg``: whole documents cut into utterances of up to 24 words; nothing is left out.

    A long document becomes many short rows at once, so no later step depends on document size.
    """
    docs = spread(table(spark, sf_dir, "documents").where("lang IN ('es', 'en')"))
    words = docs.select("doc_id", "lang", "source", raw_words(F.col("text")).alias("_w"))
    windows = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("_w") / WINDOW_WORDS).cast("int") - 1),
        lambda i: F.struct(
            i.cast("long").alias("seg_no"),
            F.slice("_w", i * WINDOW_WORDS + 1, WINDOW_WORDS).alias("words"),
        ),
    )
    return words.filter(F.size("_w") > 0).select("doc_id", "lang", "source", F.inline(windows))


def utterance_key() -> Column:
    return F.concat_ws(
        "-", F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lpad(F.col("seg_no").cast("string"), 6, "0")
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_utterances(spark, sf_dir).select(
        utterance_key().alias("utterance_id"),
        "doc_id",
        "seg_no",
        "lang",
        "source",
        F.array_join("words", " ").alias("text"),
    )


def pairs(spark: SparkSession, sf_dir: str, aligned: bool = False) -> DataFrame:
    """``v_pair``: each utterance with a damaged hypothesis (every fifth word replaced, and
    unless ``aligned`` every eleventh dropped) and keywords (its longer words, its first two)."""

    def damage(words: Column) -> Column:
        kept = words
        marked = F.transform(
            kept,
            lambda w, i: F.when((i % 11 == 7) & F.lit(not aligned), F.lit(None).cast("string"))
            .when(i % 5 == 2, F.concat(F.lit("x"), w))
            .otherwise(w),
        )
        return F.array_compact(marked)

    raw = raw_utterances(spark, sf_dir)
    keywords = F.concat(
        F.filter("words", lambda w: F.length(w) >= 9),
        F.array(F.array_join(F.slice("words", 1, 2), " ")),
    )
    return raw.select(
        utterance_key().alias("utterance_id"),
        "lang",
        F.array_join("words", " ").alias("ref"),
        F.array_join(damage(F.col("words")), " ").alias("hyp"),
        keywords.alias("keywords"),
        (F.col("seg_no") % 9 == 8).alias("guard_fired"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_tr``: one transcript per document whose segments are its utterance windows."""
    cut = raw_utterances(spark, sf_dir).select(
        "doc_id",
        "lang",
        F.struct(
            F.col("seg_no").alias("no"),
            (F.col("seg_no") * 2.0).alias("start"),
            (F.col("seg_no") * 2.0 + 1.5).alias("end"),
            F.concat(
                F.array_join("words", " "),
                # a stuttering recogniser repeats the first three words
                F.when(
                    (F.col("seg_no") + F.col("doc_id")) % 50 == 3,
                    F.repeat(
                        F.concat(F.lit(" "), F.array_join(F.slice("words", 1, 3), " ")), 4
                    ),
                ).otherwise(""),
            ).alias("text"),
            (-((F.col("doc_id") * 7 + F.col("seg_no")) % 30) / 10.0).alias("avg_logprob"),
            (((F.col("doc_id") + F.col("seg_no") * 3) % 20) / 20.0).alias("no_speech_prob"),
        ).alias("s"),
    )
    # a transcript is one row in the data model, so its segments belong together
    return cut.groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list("s")).alias("segments")).withColumn(
        "vad",
        F.transform(
            F.sequence(F.lit(0), F.size("segments") - 1),
            lambda i: F.struct(
                (i * 6.0).alias("start"), (i * 6.0 + 3.0 + (F.col("doc_id") % 3)).alias("end")
            ),
        ),
    ).withColumn("guard_flags", F.array().cast("array<string>"))
