"""Contract and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.text import tokens
from soundquay.operators import checks
from soundquay.operators.corpus import levels_table
from soundquay.operators.damage import languages_without_clean, metric_matrix
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.source_queries import _MATRIX
from soundquay.plans.views import spread, table, view
from soundquay.sources.constants import constant_table


def _reason_list(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for bad, name in pairs)
    return f"array_to_string(list_filter([{items}], lambda r: r IS NOT NULL), ',')"


@query(
    "D1",
    q.cte("v_any")
    + f"""SELECT * FROM (SELECT utterance_id, {_reason_list(
        ("trim(coalesce(text, '')) = ''", "text"),
        ("lang NOT IN ('es', 'en')", "lang"),
        ("duration_s IS NULL OR isnan(duration_s) OR duration_s <= 0", "duration_s"),
        ("trim(coalesce(source, '')) = ''", "source"),
    )} AS reasons FROM v_any) WHERE reasons <> ''""",
)
def manifest_contract(spark, sf_dir):
    bad = checks.manifest_rows(view(spark, sf_dir, "v_any"))
    return bad.select("utterance_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "D2",
    q.cte("v_bank")
    + f"""SELECT * FROM (SELECT clip_id, {_reason_list(
        ("duration_s < 3", "duration_s"),
        ("trim(license) = ''", "license"),
        ("split NOT IN ('train', 'eval')", "split"),
        ("subtype NOT IN ('AA','AB','AC','BA','BB','BC','CA','CB')", "subtype"),
    )} AS reasons FROM v_bank) WHERE reasons <> ''""",
)
def noise_bank_contract(spark, sf_dir):
    bad = checks.noise_bank_rows(view(spark, sf_dir, "v_bank"))
    return bad.select("clip_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "D3",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n
  FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "l_linenumber", F.col("l_linenumber").cast("long")
    )
    return checks.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


@query(
    "D4 U3",
    q.cte("v_bank")
    + """SELECT recording_id FROM v_bank WHERE split = 'train'
  INTERSECT SELECT recording_id FROM v_bank WHERE split = 'eval'""",
)
def split_leakage(spark, sf_dir):
    return checks.leaked_recordings(view(spark, sf_dir, "v_bank"))


@query(
    "D5",
    q.cte("v_bank")
    + """SELECT subtype, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS n_train,
  CAST(count(*) FILTER (split = 'eval') AS BIGINT) AS n_eval FROM v_bank GROUP BY subtype
  HAVING count(*) FILTER (split = 'train') < 36 OR count(*) FILTER (split = 'eval') < 15""",
)
def thin_subtypes(spark, sf_dir):
    return checks.thin_subtypes(view(spark, sf_dir, "v_bank"), 36, 15)


@query(
    "D6",
    q.cte("v_rec")
    + """, counts AS (SELECT lang, noise_subtype, noise_level, count(*) AS n FROM v_rec GROUP BY ALL),
cells AS (SELECT lang, s AS noise_subtype, l AS noise_level FROM (SELECT DISTINCT lang FROM v_rec),
  (SELECT unnest(['AA','AB','AC','BA','BB','BC','CA']) AS s),
  (SELECT unnest(['05','10','15']) AS l)),
clean AS (SELECT lang, n FROM counts WHERE noise_subtype IS NULL)
SELECT c.lang, c.noise_subtype, c.noise_level, coalesce(k.n, 0) AS n, e.n AS expected
  FROM cells c LEFT JOIN counts k ON k.lang = c.lang AND k.noise_subtype = c.noise_subtype
   AND k.noise_level = c.noise_level JOIN clean e ON e.lang = c.lang
 WHERE coalesce(k.n, 0) <> e.n""",
)
def incomplete_grid(spark, sf_dir):
    subtypes = constant_table(spark, [(s,) for s in fixed.BANK_SUBTYPES], "noise_subtype string")
    return checks.incomplete_cells(view(spark, sf_dir, "v_rec"), subtypes, levels_table(spark))


@query(
    "D7",
    q.cte("v_mix")
    + """SELECT utterance_id, round(snr_db_target, 6) AS snr_db_target,
  round(snr_db_achieved, 6) AS snr_db_achieved FROM v_mix
  WHERE abs(snr_db_achieved - snr_db_target) > 0.5 AND NOT isinf(snr_db_achieved)""",
)
def snr_off_target(spark, sf_dir):
    off = checks.off_target_snr(view(spark, sf_dir, "v_mix"))
    return off.select(
        "utterance_id",
        F.round("snr_db_target", 6).alias("snr_db_target"),
        F.round("snr_db_achieved", 6).alias("snr_db_achieved"),
    )


@query(
    "D8",
    q.cte("v_mix", "v_bank")
    + """SELECT utterance_id, noise_clip_id FROM v_mix
  WHERE noise_clip_id IN (SELECT clip_id FROM v_bank WHERE split = 'eval')""",
)
def eval_clips_in_training(spark, sf_dir):
    leaks = checks.eval_clips_in_training(
        view(spark, sf_dir, "v_mix"), view(spark, sf_dir, "v_bank")
    )
    return leaks.select("utterance_id", "noise_clip_id")


@query(
    "D9",
    q.cte("v_mix")
    + """SELECT round(clean_share, 6) AS clean_share, n_off_band,
  abs(clean_share - 0.3) <= 0.05 AND n_off_band = 0 AS ok FROM (
  SELECT avg(CASE WHEN noise_subtype IS NULL THEN 1.0 ELSE 0.0 END) AS clean_share,
  CAST(count(*) FILTER (noise_subtype IS NOT NULL AND NOT (snr_db_target BETWEEN 8 AND 15
    OR snr_db_target BETWEEN -2 AND 2 OR snr_db_target BETWEEN -7 AND -3)) AS BIGINT)
    AS n_off_band FROM v_mix)""",
)
def training_mix_shape(spark, sf_dir):
    return checks.training_mix(view(spark, sf_dir, "v_mix")).select(
        F.round("clean_share", 6).alias("clean_share"), "n_off_band", "ok"
    )


_BENCH_WORDS = f"""targets AS (SELECT DISTINCT 'en' AS lang,
  unnest(string_split({q.norm('text', "'en'")}, ' ')) AS target FROM benchmark),
covered AS (SELECT DISTINCT unnest(string_split({q.norm('text', "'en'")}, ' ')) AS target
  FROM documents WHERE lang = 'en')"""


@query(
    "D10 U2",
    f"""WITH {_BENCH_WORDS} SELECT lang, target FROM targets WHERE target <> ''
  AND target NOT IN (SELECT target FROM covered)""",
)
def uncovered_targets(spark, sf_dir):
    targets = (
        table(spark, sf_dir, "benchmark")
        .select(F.lit("en").alias("lang"), F.explode(tokens(F.col("text"), F.lit("en"))).alias("target"))
        .distinct()
    )
    carried = (
        spread(table(spark, sf_dir, "documents"))
        .filter(F.col("lang") == "en")
        .select("lang", tokens(F.col("text"), F.col("lang")).alias("keywords"))
    )
    return checks.uncovered_targets(targets, carried)


@query(
    "D11",
    q.cte("v_rec", extra=_MATRIX)
    + """, broken AS (SELECT * FROM matrix WHERE NOT (lang = 'en' AND noise_subtype IS NULL))
SELECT DISTINCT lang FROM broken WHERE lang NOT IN
  (SELECT lang FROM broken WHERE noise_subtype IS NULL)""",
)
def languages_without_clean_row(spark, sf_dir):
    matrix = metric_matrix(view(spark, sf_dir, "v_rec"))
    gone = (F.col("lang") == "en") & F.col("noise_subtype").isNull()
    return languages_without_clean(matrix.filter(~gone))
