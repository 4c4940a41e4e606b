"""Sources and sinks: manifests, merges, upserts, run logs, transcript indexes, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay.operators import operations
from soundquay.operators.damage import metric_matrix
from soundquay.operators.metrics import bundle
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.views import table, utterances, view
from soundquay.sources import manifests, tables, telemetry, transcripts
from soundquay.sources.stage import stage_table, work_folder


@query(
    "S1",
    q.cte("v_any")
    + """SELECT utterance_id, lang,
       CASE WHEN isnan(duration_s) THEN NULL ELSE round(duration_s, 6) END AS duration_s,
       source, CAST(0 AS BIGINT) AS n_keywords
  FROM v_any""",
)
def manifest_read(spark, sf_dir):
    """A manifest file with NaN for missing numbers and without keyword lists, read with its schema."""
    path = work_folder(spark, "manifest")
    manifests.write_manifest(view(spark, sf_dir, "v_any"), path)
    folded = manifests.read_manifest(spark, path)
    return folded.select(
        "utterance_id",
        "lang",
        F.round("duration_s", 6).alias("duration_s"),
        "source",
        F.size("keywords").cast("long").alias("n_keywords"),
    )


@query(
    "S2",
    q.cte("v_bank") + "SELECT clip_id, subtype, recording_id FROM v_bank WHERE split = 'eval'",
)
def noise_bank_eval_split(spark, sf_dir):
    """The bank written by split and subtype; only the files of one split are read."""
    path = work_folder(spark, "noise-bank")
    manifests.write_noise_bank(view(spark, sf_dir, "v_bank").drop("vec_id"), path)
    return manifests.read_noise_bank(spark, path, "eval").select("clip_id", "subtype", "recording_id")


def _telemetry_frame(spark, sf_dir):
    tel = view(spark, sf_dir, "v_tel")
    return tel.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("trace_id").cast("string").alias("trace_id"),
        "store_id",
        (F.col("total_ms") / 100).alias("duration_s"),
        "speech_ratio",
        "noise_pred",
        F.col("speech_ratio").alias("noise_confidence"),
        F.array().cast("array<string>").alias("chain_applied"),
        F.lit("es").alias("language"),
        (F.col("avg_logprob") * 0.7310585786).alias("avg_logprob"),
        F.when(F.col("guarded") == 1, F.array(F.lit("vad_dropped")))
        .otherwise(F.array().cast("array<string>"))
        .alias("guard_flags"),
        F.array_compact(F.array("rule_fired")).alias("rules_fired"),
        F.struct(
            F.lit(1.0).alias("vad"),
            F.lit(None).cast("double").alias("preprocess"),
            F.lit(None).cast("double").alias("asr"),
            F.lit(None).cast("double").alias("keydetector"),
            F.when(F.col("trace_id") % 25 != 0, F.col("total_ms")).alias("total"),
        ).alias("latency_ms"),
        F.lit("0.1.0").alias("model_version"),
        F.lit("secret words").alias("text"),
    )


@query(
    "S3 S4",
    q.cte("v_tel")
    + """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_lines,
       round(avg(round(total_ms, 1)), 4) AS mean_total_ms,
       CAST(sum(guarded) AS BIGINT) AS n_flagged
  FROM v_tel WHERE trace_id % 25 <> 0 GROUP BY 1""",
)
def telemetry_files_by_day(spark, sf_dir):
    """Write telemetry as JSON lines per day and read all days back; incomplete lines drop out."""
    path = work_folder(spark, "telemetry")
    telemetry.write_telemetry(_telemetry_frame(spark, sf_dir), path)
    lines = telemetry.read_telemetry(spark, path)
    return lines.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.avg("latency_ms.total"), 4).alias("mean_total_ms"),
        F.sum((F.size("guard_flags") > 0).cast("long")).alias("n_flagged"),
    )


@query(
    "P18",
    q.cte("v_tel")
    + """SELECT CAST(trace_id AS VARCHAR) AS trace_id, store_id, round(speech_ratio, 3) AS speech_ratio,
       round(avg_logprob * CAST(0.7310585786 AS DOUBLE), 3) AS avg_logprob,
       CASE WHEN trace_id % 25 <> 0 THEN round(total_ms, 1) END AS total_ms,
       CASE WHEN guarded = 1 THEN 'vad_dropped' ELSE '' END AS guard_flags,
       coalesce(rule_fired, '') AS rules_fired
  FROM v_tel""",
)
def telemetry_projection(spark, sf_dir):
    lines = operations.telemetry_lines(_telemetry_frame(spark, sf_dir))
    return lines.select(
        "trace_id",
        "store_id",
        "speech_ratio",
        "avg_logprob",
        F.col("latency_ms.total").alias("total_ms"),
        F.array_join("guard_flags", ",").alias("guard_flags"),
        F.array_join("rules_fired", ",").alias("rules_fired"),
    )


_LINES = f"""WITH {q.SEG}, v_line AS (
  SELECT utterance_id, doc_id, seg_no,
         CASE WHEN seg_no % 5 = 4 THEN utterance_id || chr(9) || ' '
              ELSE utterance_id || chr(9) || ' ' || chr(9) || text END AS tab_value,
         CASE WHEN seg_no % 5 = 4 THEN utterance_id ELSE utterance_id || ' ' || text END
           AS word_value, text FROM v_seg)
"""


def _lines(spark, sf_dir):
    utts = utterances(spark, sf_dir)
    broken = F.col("seg_no") % 5 == 4
    return utts.select(
        F.when(broken, F.concat("utterance_id", F.lit("\t ")))
        .otherwise(F.concat("utterance_id", F.lit("\t \t"), "text"))
        .alias("tab_value"),
        F.when(broken, F.col("utterance_id"))
        .otherwise(F.concat("utterance_id", F.lit(" "), "text"))
        .alias("word_value"),
    )


def _written(spark, sf_dir, value):
    """An index as text files in folders, as collections come."""
    path = work_folder(spark, "index")
    folder = F.pmod(F.xxhash64(value), F.lit(4)).alias("fold")
    _lines(spark, sf_dir).select(value, folder).write.partitionBy("fold").text(path)
    return path


@query("S5", _LINES + "SELECT utterance_id AS file_id, text FROM v_line WHERE seg_no % 5 <> 4")
def transcript_index_tabs(spark, sf_dir):
    return transcripts.read_tab_index(spark, _written(spark, sf_dir, "tab_value"))


@query("S6", _LINES + "SELECT utterance_id AS file_id, text FROM v_line WHERE seg_no % 5 <> 4")
def transcript_index_words(spark, sf_dir):
    return transcripts.read_word_index(spark, _written(spark, sf_dir, "word_value"))


@query(
    "S7",
    _LINES
    + """SELECT l.utterance_id AS file_id, 'fold/' || l.utterance_id || '.flac' AS path,
       CAST(length(text) AS BIGINT) AS n_chars
  FROM v_line l JOIN labels b ON l.doc_id = b.doc_id WHERE seg_no % 5 <> 4""",
)
def audio_with_transcripts(spark, sf_dir):
    """Files of the labelled documents that a transcript index knows."""
    utts = utterances(spark, sf_dir)
    labelled = utts.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    files = labelled.select(F.concat(F.lit("fold/"), "utterance_id", F.lit(".flac")).alias("path"))
    index = transcripts.read_tab_index(spark, _written(spark, sf_dir, "tab_value"))
    return transcripts.join_transcripts(files, index).select(
        "file_id", "path", F.length("text").cast("long").alias("n_chars")
    )


@query(
    "S8 J6",
    q.cte("v_utt")
    + """, batch AS (SELECT 'new-' || utterance_id AS utterance_id, source, lang FROM v_utt
         WHERE source LIKE 'src1%')
SELECT utterance_id, source, lang FROM v_utt WHERE source NOT IN (SELECT source FROM batch)
UNION ALL SELECT * FROM batch""",
)
def manifest_merge(spark, sf_dir):
    old = view(spark, sf_dir, "v_utt").select("utterance_id", "source", "lang")
    batch = old.filter(F.col("source").startswith("src1")).withColumn(
        "utterance_id", F.concat(F.lit("new-"), "utterance_id")
    )
    return manifests.merge_batch(old, batch, ["source"])


@query(
    "S9",
    """WITH last AS (SELECT o_custkey, o_orderstatus, round(o_totalprice, 2) AS total,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT c.c_custkey AS id, coalesce(l.o_orderstatus, 'none') AS status,
       coalesce(l.total, 0.0) AS total
  FROM customer c LEFT JOIN last l ON l.o_custkey = c.c_custkey AND l.rn = 1
UNION ALL
SELECT l.o_custkey, l.o_orderstatus, l.total FROM last l
 WHERE rn = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def upsert_last_write(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("none").alias("status"), F.lit(0.0).alias("total")
    )
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.round("o_totalprice", 2).alias("total"),
        F.col("o_orderkey").alias("seq"),
    )
    return tables.upsert(current, changes, ["id"], "seq")


@query(
    "S10",
    f"""WITH {q.SEG}, top AS (SELECT max(doc_id) AS m FROM labels)
SELECT doc_id AS id, 'label-' || CAST(doc_id AS VARCHAR) AS utterance_id FROM labels
UNION ALL
SELECT m + row_number() OVER (ORDER BY utterance_id), utterance_id FROM v_seg, top""",
)
def append_generated_ids(spark, sf_dir):
    current = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("label-"), F.col("doc_id").cast("string")).alias("utterance_id"),
    )
    rows = utterances(spark, sf_dir).select("utterance_id")
    return tables.append_with_ids(current, rows, ["utterance_id"])


_MATRIX = """matrix AS (SELECT lang, noise_subtype, noise_level,
  CASE WHEN sum(ref_words) > 0 THEN CAST(sum(word_edits) AS DOUBLE) / sum(ref_words) END AS wer,
  CASE WHEN sum(n_keywords) > 0 THEN 1 - CAST(sum(n_recovered) AS DOUBLE) / sum(n_keywords) END
    AS ker,
  CAST(sum(hallucinated) AS DOUBLE) / count(*) AS hallucination_rate,
  count(*) AS n_utts FROM v_rec GROUP BY ALL)"""


@query(
    "S11 U1",
    q.cte("v_rec", extra=_MATRIX)
    + "SELECT lang, noise_subtype, noise_level, round(wer, 6) AS wer, n_utts FROM matrix",
)
def staged_fragments(spark, sf_dir):
    """Matrix fragments written per language by separate stages, read back as one table."""
    base = work_folder(spark, "fragments")
    rec = view(spark, sf_dir, "v_rec")
    paths = []
    for lang in ("es", "en"):
        paths.append(f"{base}/{lang}")
        metric_matrix(rec.filter(F.col("lang") == lang)).write.parquet(paths[-1])
    return manifests.concat_fragments(spark, *paths).select(
        "lang", "noise_subtype", "noise_level", F.round("wer", 6).alias("wer"), "n_utts"
    )


@query(
    "S12",
    q.cte("v_rec")
    + """SELECT count(*) AS row_count, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs,
  CAST(sum(CASE WHEN noise_subtype IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_clean,
  CAST(sum(CASE WHEN noise_subtype IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_mixed,
  round(sum(duration_s) / 3600, 4) AS hours FROM v_rec""",
)
def dataset_summary(spark, sf_dir):
    return manifests.summary(view(spark, sf_dir, "v_rec")).select(
        "row_count",
        F.array_join("langs", ",").alias("langs"),
        "n_clean",
        "n_mixed",
        F.round("hours", 4).alias("hours"),
    )


@query(
    "S13 P26",
    q.cte("v_rec")
    + """SELECT 'run-20240101T000000Z-0.1.0' AS run_id, lang,
  round(CAST(sum(word_edits) AS DOUBLE) / sum(ref_words), 6) AS wer, count(*) AS n_utts,
  CAST(1337 AS BIGINT) AS seed, true AS same_as_log
  FROM v_rec GROUP BY lang""",
)
def metric_run_log(spark, sf_dir):
    """A run's report as a JSON document, read back typed and held against its row in the log."""
    path = work_folder(spark, "metric-runs")
    reports = work_folder(spark, "reports")
    run = ("run-20240101T000000Z-0.1.0", "0.1.0", "scored")
    rates = stage_table(bundle(view(spark, sf_dir, "v_rec")), "rates")
    tables.append_run(rates, path, *run)
    tables.write_report(rates, reports, *run, 1337)
    document = F.from_json("metrics_json", "map<string, struct<wer: double, n_utts: bigint>>")
    logged = spark.read.parquet(path).select("run_id", F.explode(document).alias("lang", "logged"))
    report = tables.read_reports(spark, reports).select("run_id", "seed", F.explode("metrics").alias("lang", "m"))
    same = (F.col("m.wer") == F.col("logged.wer")) & (F.col("m.n_utts") == F.col("logged.n_utts"))
    return report.join(logged, ["run_id", "lang"]).select(
        "run_id", "lang", F.round("m.wer", 6).alias("wer"), "m.n_utts", "seed", same.alias("same_as_log")
    )


_RUNS = """runs AS (SELECT
  CASE WHEN o_orderkey % 3 = 0 THEN 'draft-' ELSE 'run-' END || strftime(o_orderdate, '%Y%m%d')
    || 'T000000Z-' || CAST(o_orderkey AS VARCHAR) AS run_id,
  o_orderkey, o_orderdate, o_totalprice FROM orders)"""


def _runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    prefix = F.when(F.col("o_orderkey") % 3 == 0, "draft-").otherwise("run-")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")
    return orders.select(
        F.concat(prefix, day, F.lit("T000000Z-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.lit("0.1.0").alias("model_version"),
        F.lit("scored").alias("dataset_id"),
        # metrics documents as the service stores them: an empty language, then a measured one
        F.format_string(
            '{"es": {"n": 0}, "en": {"wer": %s}}', F.round(F.col("o_totalprice") / 1e6, 6).cast("string")
        ).alias("metrics_json"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("created_at"),
    )


@query(
    "S14",
    f"WITH {_RUNS} SELECT run_id FROM runs WHERE run_id LIKE 'run-%' ORDER BY run_id DESC LIMIT 5",
)
def latest_runs(spark, sf_dir):
    return operations.latest_runs(_runs(spark, sf_dir), 5).select("run_id")


@query(
    "A40",
    f"""WITH {_RUNS} SELECT run_id, round(o_totalprice / 1e6, 6) AS wer,
  strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM runs
  ORDER BY created_at DESC, run_id DESC LIMIT 20""",
)
def eval_run_trend(spark, sf_dir):
    return operations.run_trend(_runs(spark, sf_dir)).select("run_id", "wer", "created_at")


@query(
    "P26",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS high FROM events""",
)
def json_metadata(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", k.alias("k"), (k > 50).alias("high"))
