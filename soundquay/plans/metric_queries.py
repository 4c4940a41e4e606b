"""Error rates, noise damage, policy, gates and classifier quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.operators import classifier, damage, gates, metrics, policy
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.source_queries import _MATRIX
from soundquay.plans.views import pairs, table, view
from soundquay.sources.constants import constant_table

_SIX = 6


def _r(column: str, places: int = _SIX):
    return F.round(column, places).alias(column)


def _edit_sql(aligned: bool = False) -> str:
    """Normalised pairs with word and character edits; words and letters are written as one
    ASCII sign each because the SQL engine compares bytes."""
    letters_r, letters_h = "string_split(ref_n, '')", "string_split(hyp_n, '')"
    return f"""{q.pair_cte(aligned)},
n AS (SELECT *, {q.norm('ref', 'lang')} AS ref_n, {q.norm('hyp', 'lang')} AS hyp_n FROM v_pair),
w AS (SELECT *, {q.words('ref_n')} AS rw, {q.words('hyp_n')} AS hw FROM n),
e AS (SELECT *, list_distinct(list_concat(rw, hw)) AS vocab,
  list_distinct(list_concat({letters_r}, {letters_h})) AS letters FROM w),
d AS (SELECT *, CASE WHEN ref_n = '' THEN 0 ELSE
    levenshtein({q.words_to_symbols('rw', 'vocab')}, {q.words_to_symbols('hw', 'vocab')}) END
    AS word_edits,
  CASE WHEN ref_n = '' THEN 0 ELSE levenshtein(
    {q.words_to_symbols(letters_r, 'letters')}, {q.words_to_symbols(letters_h, 'letters')}) END
    AS char_edits, len(rw) AS ref_words, length(ref_n) AS ref_chars FROM e)"""


@query(
    "A1 A2",
    f"""WITH {_edit_sql()} SELECT lang,
  CAST(sum(word_edits) AS BIGINT) AS word_edits, CAST(sum(ref_words) AS BIGINT) AS ref_words,
  round(CAST(sum(word_edits) AS DOUBLE) / sum(ref_words), 6) AS wer,
  round(CAST(sum(char_edits) AS DOUBLE) / sum(ref_chars), 6) AS cer FROM d GROUP BY lang""",
)
def corpus_error_rates(spark, sf_dir):
    measured = metrics.measure(pairs(spark, sf_dir).drop("keywords"), sound=False)
    return measured.groupBy("lang").agg(
        F.sum("word_edits").alias("word_edits"),
        F.sum("ref_words").alias("ref_words"),
        F.round(metrics.wer(), 6).alias("wer"),
        F.round(metrics.cer(), 6).alias("cer"),
    )


@query(
    "A1",
    f"""WITH {_edit_sql()} SELECT utterance_id, CAST(word_edits AS BIGINT) AS word_edits,
  CAST(char_edits AS BIGINT) AS char_edits, CAST(ref_words AS BIGINT) AS ref_words FROM d""",
)
def utterance_edits(spark, sf_dir):
    measured = metrics.measure(pairs(spark, sf_dir).drop("keywords"), sound=False)
    return measured.select("utterance_id", "word_edits", "char_edits", "ref_words")


# keywords one per row, in normal form, with the words and sound keys of both sides
_KEYWORDS = f"""{q.pair_cte()},
n AS (SELECT utterance_id, lang, guard_fired, {q.norm('ref', 'lang')} AS ref_n,
  {q.norm('hyp', 'lang')} AS hyp_n, keywords FROM v_pair),
k AS (SELECT utterance_id, lang, hyp_n, {q.norm('kw', 'lang')} AS kw FROM (
  SELECT utterance_id, lang, hyp_n, unnest(keywords) AS kw FROM n)),
exact AS (SELECT *, kw <> '' AND contains(' ' || hyp_n || ' ', ' ' || kw || ' ') AS hit FROM k)"""

_EN_CODE, _EN_PLAIN = q.en_key("word")

_SOUNDS = f"""{_KEYWORDS},
vocab AS (SELECT DISTINCT lang, unnest(string_split(kw || ' ' || hyp_n, ' ')) AS word
  FROM exact WHERE NOT hit),
coded AS (SELECT lang, word, {q.es_key('word')} AS es_code, {_EN_CODE} AS en_code,
  {_EN_PLAIN} AS plain FROM vocab WHERE word <> ''),
sounds AS (SELECT lang, word, CASE WHEN lang = 'es' THEN es_code
  WHEN coalesce(en_code, '') = '' THEN plain ELSE en_code END AS sound FROM coded),
missed AS (SELECT row_number() OVER () AS rid, * FROM (SELECT * FROM exact WHERE NOT hit)),
kw_words AS (SELECT rid, lang, list_position AS pos, word FROM (SELECT rid, lang,
  unnest(string_split(kw, ' ')) AS word, generate_subscripts(string_split(kw, ' '), 1)
    AS list_position FROM missed WHERE kw <> '')),
hyp_words AS (SELECT rid, lang, list_position AS pos, word FROM (SELECT rid, lang,
  unnest(string_split(hyp_n, ' ')) AS word, generate_subscripts(string_split(hyp_n, ' '), 1)
    AS list_position FROM missed WHERE hyp_n <> '')),
kw_sound AS (SELECT rid, string_agg(sound, '|' ORDER BY pos) AS s FROM kw_words
  JOIN sounds USING (lang, word) GROUP BY rid),
hyp_sound AS (SELECT rid, string_agg(sound, '|' ORDER BY pos) AS s FROM hyp_words
  JOIN sounds USING (lang, word) GROUP BY rid),
heard AS (SELECT k.rid FROM kw_sound k JOIN hyp_sound h USING (rid)
  WHERE contains('|' || h.s || '|', '|' || k.s || '|')),
scored AS (SELECT utterance_id, lang, 1 AS hit FROM exact WHERE hit
  UNION ALL SELECT utterance_id, lang, CASE WHEN h.rid IS NULL THEN 0 ELSE 1 END
  FROM missed m LEFT JOIN heard h USING (rid))"""


@query(
    "A3",
    f"""WITH {_SOUNDS} SELECT lang, count(*) AS n_keywords, CAST(sum(hit) AS BIGINT) AS n_recovered,
  round(1 - CAST(sum(hit) AS DOUBLE) / count(*), 6) AS ker FROM scored GROUP BY lang""",
)
def keyword_error_rates(spark, sf_dir):
    """Keywords found word for word or by equal sound keys."""
    measured = metrics.measure(pairs(spark, sf_dir))
    return measured.groupBy("lang").agg(
        F.sum("n_keywords").alias("n_keywords"),
        F.sum("n_recovered").alias("n_recovered"),
        F.round(metrics.ker(), 6).alias("ker"),
    )


@query(
    "A3",
    f"""WITH {_KEYWORDS} SELECT lang, count(*) AS n_keywords,
  CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_exact FROM exact GROUP BY lang""",
)
def exact_keywords(spark, sf_dir):
    measured = metrics.measure(pairs(spark, sf_dir), sound=False)
    return measured.groupBy("lang").agg(
        F.sum("n_keywords").alias("n_keywords"), F.sum("n_recovered").alias("n_exact")
    )


@query(
    "A12",
    f"""WITH {_SOUNDS}, total AS (SELECT lang, count(*) AS n, sum(hit) AS h FROM scored
  GROUP BY lang) SELECT lang, round(CASE WHEN n = 0 THEN 1.0 ELSE CAST(h AS DOUBLE) / n END, 6)
  AS keyword_recall FROM total UNION ALL SELECT 'none', 1.0""",
)
def keyword_recalls(spark, sf_dir):
    """Recall per language, and 1 for a set without any keyword."""
    sound = metrics.measure(pairs(spark, sf_dir))
    none = pairs(spark, sf_dir).withColumn("keywords", F.array().cast("array<string>"))
    empty = metrics.measure(none).withColumn("lang", F.lit("none"))
    return sound.unionByName(empty).groupBy("lang").agg(
        F.round(metrics.keyword_recall(), 6).alias("keyword_recall")
    )


@query(
    "A4",
    f"""WITH {q.pair_cte()}, n AS (SELECT lang, guard_fired, {q.norm('ref', 'lang')} AS r,
  {q.norm('hyp', 'lang')} AS h FROM v_pair)
SELECT lang, round(avg(CASE WHEN (r = '' AND h <> '') OR guard_fired THEN 1.0 ELSE 0.0 END), 6)
  AS hallucination_rate, count(*) AS n_utts FROM n GROUP BY lang""",
)
def hallucination_rates(spark, sf_dir):
    measured = metrics.measure(pairs(spark, sf_dir), sound=False)
    return measured.groupBy("lang").agg(
        F.round(metrics.hallucination_rate(), 6).alias("hallucination_rate"),
        F.count(F.lit(1)).alias("n_utts"),
    )


@query(
    "A5",
    q.cte("v_rec")
    + """SELECT lang, round(CAST(sum(word_edits) AS DOUBLE) / sum(ref_words), 6) AS wer,
  round(1 - CAST(sum(n_recovered) AS DOUBLE) / sum(n_keywords), 6) AS ker,
  round(CAST(sum(hallucinated) AS DOUBLE) / count(*), 6) AS hallucination_rate,
  count(*) AS n_utts, CAST(sum(n_keywords) AS BIGINT) AS n_keywords,
  round(avg(avg_logprob), 6) AS avg_logprob_mean FROM v_rec GROUP BY lang""",
)
def metric_bundle(spark, sf_dir):
    return metrics.bundle(view(spark, sf_dir, "v_rec")).select(
        "lang", _r("wer"), _r("ker"), _r("hallucination_rate"), "n_utts", "n_keywords",
        _r("avg_logprob_mean"),
    )


@query(
    "A6",
    q.cte("v_rec", extra=_MATRIX)
    + """SELECT lang, noise_subtype, noise_level, round(wer, 6) AS wer, round(ker, 6) AS ker,
  round(hallucination_rate, 6) AS hallucination_rate, n_utts FROM matrix""",
)
def metric_matrix(spark, sf_dir):
    matrix = damage.metric_matrix(view(spark, sf_dir, "v_rec"))
    return matrix.select(
        "lang", "noise_subtype", "noise_level", _r("wer"), _r("ker"), _r("hallucination_rate"),
        "n_utts",
    )


_CELLS = """base AS (SELECT lang, coalesce(wer, 0) AS cw, ker AS ck FROM matrix
  WHERE noise_subtype IS NULL),
cells AS (SELECT m.lang, m.noise_subtype, m.noise_level, b.cw AS clean_wer, round(
    0.5 * (coalesce(wer, 0) - cw) / greatest(cw, 0.01)
  + 0.4 * CASE WHEN ker IS NULL OR ck IS NULL THEN 0 ELSE (ker - ck) / greatest(ck, 0.01) END
  + 0.1 * coalesce(hallucination_rate, 0), 4) AS ndi
  FROM matrix m JOIN base b USING (lang) WHERE noise_subtype IS NOT NULL),
ranking AS (SELECT lang, noise_subtype, round(avg(ndi), 4) AS ndi,
  string_agg(noise_level || '=' || printf('%.4f', ndi), ',' ORDER BY noise_level) AS per_level
  FROM cells GROUP BY lang, noise_subtype)"""


def _cells(spark, sf_dir):
    return damage.damage_cells(damage.metric_matrix(view(spark, sf_dir, "v_rec")))


@query(
    "A7 J10 P23",
    q.cte("v_rec", extra=f"{_MATRIX}, {_CELLS}")
    + """SELECT lang, noise_subtype, noise_level, round(clean_wer, 6) AS clean_wer, ndi
  FROM cells""",
)
def damage_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select(
        "lang", "noise_subtype", "noise_level", _r("clean_wer"), "ndi"
    )


@query(
    "A8 A6 A7 J10",
    q.cte("v_rec", extra=f"{_MATRIX}, {_CELLS}")
    + "SELECT lang, noise_subtype, ndi, per_level FROM ranking",
)
def damage_ranking(spark, sf_dir):
    """Noise subtypes by the damage they do, worst first."""
    ranking = damage.damage_ranking(_cells(spark, sf_dir))
    levels = F.transform(
        F.map_entries("per_level"),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])),
    )
    return ranking.select(
        "lang", "noise_subtype", "ndi", F.array_join(levels, ",").alias("per_level")
    )


@query(
    "A9",
    q.cte("v_rec", extra=f"{_MATRIX}, {_CELLS}")
    + """SELECT lang, place, noise_subtype, ndi FROM (SELECT *, row_number() OVER (
  PARTITION BY lang ORDER BY ndi DESC, noise_subtype) AS place FROM ranking) WHERE place <= 3""",
)
def top_damaging(spark, sf_dir):
    return damage.top_subtypes(damage.damage_ranking(_cells(spark, sf_dir)))


_GRID = """grid AS (SELECT lang, noise_subtype,
  max(CASE WHEN noise_level = '05' THEN wer END) AS wer_05,
  max(CASE WHEN noise_level = '10' THEN wer END) AS wer_10,
  max(CASE WHEN noise_level = '15' THEN wer END) AS wer_15
  FROM matrix WHERE noise_subtype IS NOT NULL GROUP BY ALL)"""


def _grid_columns(df):
    return df.select(
        "lang",
        "noise_subtype",
        *[F.round(level, 6).alias(f"wer_{level}") for level in fixed.CANONICAL_LEVELS],
    )


_GRID_OUT = """SELECT lang, noise_subtype, round(wer_05, 6) AS wer_05,
  round(wer_10, 6) AS wer_10, round(wer_15, 6) AS wer_15 FROM grid"""


@query(
    "A10",
    q.cte("v_rec", extra=f"{_MATRIX}, {_GRID}")
    + _GRID_OUT
    + """ WHERE wer_05 IS NOT NULL AND wer_10 IS NOT NULL AND wer_15 IS NOT NULL
  AND NOT (wer_05 <= wer_10 AND wer_10 <= wer_15)""",
)
def not_rising_with_level(spark, sf_dir):
    return _grid_columns(damage.not_rising(damage.metric_matrix(view(spark, sf_dir, "v_rec"))))


@query("A11", q.cte("v_rec", extra=f"{_MATRIX}, {_GRID}") + _GRID_OUT)
def wer_heatmap(spark, sf_dir):
    return _grid_columns(damage.wer_grid(damage.metric_matrix(view(spark, sf_dir, "v_rec"))))


_POLICY = """means AS (SELECT lang, subtype, chain, min(chain_order) AS o, avg(wer) AS wer,
  avg(ker) AS ker, avg(latency_ms) AS latency_ms FROM v_chain GROUP BY ALL),
real AS (SELECT * FROM means WHERE subtype <> '__clean__'),
rel AS (SELECT c.subtype, c.chain, c.o, c.lang, (n.wer - c.wer) / greatest(n.wer, 1e-6) AS rel,
  n.wer IS NOT NULL AND c.ker <= n.ker + 1e-6 AND c.latency_ms <= 400 AS ok
  FROM real c LEFT JOIN real n ON n.lang = c.lang AND n.subtype = c.subtype AND n.chain = 'none'
  WHERE c.chain <> 'none'),
score AS (SELECT subtype, chain, min(o) AS o, min(rel) AS worst, bool_and(ok AND rel >= 0.03) AS ok,
  count(*) AS n FROM rel GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY worst DESC, o) AS rn
  FROM score WHERE ok AND n = (SELECT count(DISTINCT lang) FROM means)),
policy AS (SELECT s.subtype, coalesce(b.chain, 'none') AS chain FROM (
  SELECT unnest(['AA','AB','AC','BA','BB','BC','CA']) AS subtype) s
  LEFT JOIN best b ON b.subtype = s.subtype AND b.rn = 1)"""


def _bank_subtypes(spark):
    return constant_table(spark, [(s,) for s in fixed.BANK_SUBTYPES], "subtype string")


def _policy(spark, sf_dir):
    effect = view(spark, sf_dir, "v_chain").filter(F.col("subtype") != fixed.CLEAN_KEY)
    return policy.generate_policy(effect, _bank_subtypes(spark))


@query("A20", q.cte("v_chain", extra=_POLICY) + "SELECT subtype, chain FROM policy")
def mitigation_policy(spark, sf_dir):
    return _policy(spark, sf_dir)


@query(
    "A20",
    q.cte("v_chain", extra=_POLICY)
    + "SELECT subtype, chain, round(worst, 6) AS worst_gain, ok AS allowed FROM score",
)
def chain_scores(spark, sf_dir):
    effect = view(spark, sf_dir, "v_chain").filter(F.col("subtype") != fixed.CLEAN_KEY)
    return policy.chain_scores(effect).select("subtype", "chain", _r("worst_gain"), "allowed")


@query(
    "A21",
    q.cte("v_chain", extra=_POLICY)
    + """SELECT p.subtype, p.chain,
  round(min((n.wer - c.wer) / greatest(n.wer, 1e-6)), 6) AS worst_gain,
  round(max(c.latency_ms), 4) AS latency_ms, p.chain = 'none' AS residual
  FROM policy p LEFT JOIN means c ON c.subtype = p.subtype AND c.chain = p.chain
   AND p.chain <> 'none'
  LEFT JOIN means n ON n.subtype = p.subtype AND n.chain = 'none' AND n.lang = c.lang
  GROUP BY p.subtype, p.chain""",
)
def effectiveness_report(spark, sf_dir):
    report = policy.effectiveness_report(
        view(spark, sf_dir, "v_chain"), _policy(spark, sf_dir)
    )
    return report.select(
        "subtype", "chain", _r("worst_gain"), _r("latency_ms", 4), "residual"
    )


@query(
    "A21",
    q.cte("v_chain", extra=_POLICY)
    + """SELECT c.lang, c.chain, round((n.wer - c.wer) / greatest(n.wer, 1e-6), 6) AS gain,
  (n.wer - c.wer) / greatest(n.wer, 1e-6) < -0.01 AS harms
  FROM means c JOIN means n ON n.lang = c.lang AND n.subtype = c.subtype AND n.chain = 'none'
  WHERE c.subtype = '__clean__' AND c.chain <> 'none'""",
)
def clean_harm(spark, sf_dir):
    harm = policy.clean_harm(view(spark, sf_dir, "v_chain"))
    return harm.select("lang", "chain", _r("gain"), "harms")


@query(
    "A22",
    q.cte("v_chain", extra=_POLICY) + "SELECT subtype FROM policy WHERE chain = 'none'",
)
def residual_subtypes(spark, sf_dir):
    return policy.residual_subtypes(_bank_subtypes(spark), _policy(spark, sf_dir))


@query(
    "P24",
    q.cte("v_tel", "v_chain", extra=_POLICY)
    + """SELECT trace_id, noise_pred, coalesce(chain, 'none') AS chain,
  CASE WHEN coalesce(chain, 'none') = 'none' THEN '' ELSE chain END AS applied
  FROM v_tel LEFT JOIN policy ON subtype = noise_pred""",
)
def policy_lookup(spark, sf_dir):
    tel = view(spark, sf_dir, "v_tel").select("trace_id", "noise_pred")
    out = policy.apply_policy(tel, _policy(spark, sf_dir), "active")
    return out.select(
        "trace_id", "noise_pred", "chain", F.array_join("chain_applied", ",").alias("applied")
    )


_EFFECT = """effect AS (SELECT lang, subtype, level, chain,
  CAST(sum(word_edits) AS DOUBLE) / sum(ref_words) AS wer,
  1 - CAST(sum(n_recovered) AS DOUBLE) / sum(n_keywords) AS ker, count(*) AS n,
  avg(latency_ms) AS latency_ms FROM v_chain GROUP BY ALL)"""


def _effect(spark, sf_dir):
    measured = view(spark, sf_dir, "v_chain").select(
        "lang", "subtype", "level", "chain", "ref_words", "word_edits", "n_keywords",
        "n_recovered", "hallucinated", "latency_ms",
    )
    return policy.chain_effectiveness(measured)


@query(
    "A19",
    q.cte("v_chain", extra=_EFFECT)
    + """SELECT lang, subtype, level, chain, round(wer, 6) AS wer, round(ker, 6) AS ker, n,
  round(latency_ms, 4) AS latency_ms FROM effect""",
)
def chain_effectiveness(spark, sf_dir):
    return _effect(spark, sf_dir).select(
        "lang", "subtype", "level", "chain", _r("wer"), _r("ker"), "n", _r("latency_ms", 4)
    )


@query(
    "J9",
    q.cte("v_chain", extra=_EFFECT)
    + """SELECT a.lang, a.subtype, a.level, a.chain, round(a.wer - b.wer, 6) AS d_wer_vs_none
  FROM effect a LEFT JOIN effect b ON a.lang = b.lang AND a.subtype = b.subtype
   AND a.level IS NOT DISTINCT FROM b.level AND b.chain = 'none'""",
)
def delta_against_untouched(spark, sf_dir):
    delta = policy.delta_against_none(_effect(spark, sf_dir))
    return delta.select("lang", "subtype", "level", "chain", _r("d_wer_vs_none"))


@query(
    "A23",
    q.cte("v_rec", "v_chain", extra=f"{_MATRIX}, {_CELLS}, {_POLICY}")
    + """, vals AS (SELECT r.lang, r.noise_subtype,
  r.ndi * CASE WHEN p.chain = 'none' THEN 1.5 ELSE 1.0 END / 0.5 AS z
  FROM ranking r JOIN policy p ON p.subtype = r.noise_subtype),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY lang)) AS e FROM vals)
SELECT lang, noise_subtype, round(e / sum(e) OVER (PARTITION BY lang), 6) AS weight FROM e""",
)
def sampling_weights(spark, sf_dir):
    ranking = damage.damage_ranking(_cells(spark, sf_dir))
    subtypes = _bank_subtypes(spark).withColumnRenamed("subtype", "noise_subtype")
    residual = policy.residual_subtypes(
        _bank_subtypes(spark), _policy(spark, sf_dir)
    ).withColumnRenamed("subtype", "noise_subtype")
    return damage.sampling_weights(ranking, subtypes, residual).select(
        "lang", "noise_subtype", _r("weight")
    )


# base and candidate models: the first and second half of the scored lines by part key
_SIDES = """side AS (SELECT CASE l_linestatus WHEN 'F' THEN 'es' ELSE 'en' END AS lang,
  CASE WHEN l_partkey % 2 = 0 THEN 'base' ELSE 'cand' END AS model,
  avg(CASE WHEN l_suppkey % 8 > 0 THEN l_discount * (CASE WHEN l_partkey % 2 = 0 THEN 5 ELSE
     CASE l_linestatus WHEN 'F' THEN 4 ELSE 4.6 END END) END) AS noisy_wer,
  avg(CASE WHEN l_suppkey % 8 = 0 THEN l_discount END) AS clean_wer,
  1 - avg(l_tax) AS keyword_recall, avg(l_discount) AS generic_wer FROM lineitem GROUP BY ALL),
gate AS (SELECT b.lang, (b.noisy_wer - c.noisy_wer) / greatest(b.noisy_wer, 1e-6) AS noisy_gain,
  (c.clean_wer - b.clean_wer) / greatest(b.clean_wer, 1e-6) AS clean_regression,
  b.keyword_recall - c.keyword_recall AS recall_drop,
  (c.generic_wer - b.generic_wer) / greatest(b.generic_wer, 1e-6) AS generic_regression
  FROM side b JOIN side c ON b.lang = c.lang AND b.model = 'base' AND c.model = 'cand')"""


def _sides(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    noisy = F.col("l_suppkey") % 8 > 0
    factor = F.when(F.col("l_partkey") % 2 == 0, 5.0).otherwise(
        F.when(F.col("l_linestatus") == "F", 4.0).otherwise(4.6)
    )
    side = line.groupBy(
        F.when(F.col("l_linestatus") == "F", "es").otherwise("en").alias("lang"),
        F.when(F.col("l_partkey") % 2 == 0, "base").otherwise("cand").alias("model"),
    ).agg(
        F.avg(F.when(noisy, F.col("l_discount") * factor)).alias("noisy_wer"),
        F.avg(F.when(~noisy, F.col("l_discount"))).alias("clean_wer"),
        (1 - F.avg("l_tax")).alias("keyword_recall"),
        F.avg("l_discount").alias("generic_wer"),
    )
    return side.filter("model = 'base'").drop("model"), side.filter("model = 'cand'").drop("model")


@query(
    "A24 J11",
    f"""WITH {_SIDES} SELECT lang, round(noisy_gain, 4) AS noisy_gain,
  round(clean_regression, 4) AS clean_regression, round(recall_drop, 4) AS recall_drop,
  concat_ws(',', CASE WHEN noisy_gain < 0.15 THEN 'noisy_gain' END,
    CASE WHEN clean_regression > 0.02 THEN 'clean_regression' END,
    CASE WHEN recall_drop > 0.01 THEN 'recall_drop' END) AS reasons,
  noisy_gain >= 0.15 AND clean_regression <= 0.02 AND recall_drop <= 0.01 AS passed FROM gate""",
)
def promotion_decisions(spark, sf_dir):
    base, cand = _sides(spark, sf_dir)
    return gates.promotion_decision(base, cand).withColumn(
        "reasons", F.array_join("reasons", ",")
    )


@query(
    "A24",
    f"""WITH {_SIDES}, ok AS (SELECT noisy_gain >= 0.15 AND clean_regression <= 0.02
  AND recall_drop <= 0.01 AS passed FROM gate) SELECT bool_and(passed) AS promote FROM ok""",
)
def promotion_overall(spark, sf_dir):
    base, cand = _sides(spark, sf_dir)
    return gates.overall(gates.promotion_decision(base, cand)).select("promote")


@query(
    "A25 J11",
    f"""WITH {_SIDES} SELECT lang, round(recall_drop, 4) AS recall_drop,
  round(generic_regression, 4) AS generic_regression,
  concat_ws(',', CASE WHEN recall_drop > 0.01 THEN 'recall_drop' END,
    CASE WHEN generic_regression > 0.02 THEN 'generic_regression' END) AS reasons,
  recall_drop <= 0.01 AND generic_regression <= 0.02 AS passed FROM gate""",
)
def regression_decisions(spark, sf_dir):
    base, cand = _sides(spark, sf_dir)
    return gates.regression_decision(base, cand).withColumn(
        "reasons", F.array_join("reasons", ",")
    )


@query(
    "A13",
    f"""WITH {_KEYWORDS}, kw AS (SELECT lang, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS recall
  FROM exact e JOIN v_seg s USING (utterance_id, lang) WHERE seg_no % 2 = 0 GROUP BY lang),

gen AS (SELECT p.lang, {q.norm('p.ref', 'p.lang')} AS r, {q.norm('p.hyp', 'p.lang')} AS h
  FROM v_pair p JOIN v_seg s USING (utterance_id) WHERE s.seg_no % 2 = 1),
gw AS (SELECT lang, {q.words('r')} AS rw, {q.words('h')} AS hw FROM gen WHERE r <> ''),
gv AS (SELECT lang, rw, hw, list_distinct(list_concat(rw, hw)) AS vocab FROM gw),
ge AS (SELECT lang, CAST(sum(levenshtein({q.words_to_symbols('rw', 'vocab')},
  {q.words_to_symbols('hw', 'vocab')})) AS DOUBLE) / sum(len(rw)) AS wer FROM gv GROUP BY lang)
SELECT lang, round(recall, 6) AS keyword_recall, round(wer, 6) AS generic_wer
  FROM kw JOIN ge USING (lang)""",
)
def regression_report(spark, sf_dir):
    """Recall on the keyword part (even windows), error rate on the general part (odd ones)."""
    both = pairs(spark, sf_dir)
    number = F.element_at(F.split("utterance_id", "-"), -1).cast("int")
    parted = both.withColumn("part", F.when(number % 2 == 0, "keyword").otherwise("generic"))
    report = metrics.regression_report(metrics.measure(parted, sound=False))
    return report.select("lang", _r("keyword_recall"), _r("generic_wer"))


@query(
    "A14 K5",
    f"""WITH {_KEYWORDS}, fixed_n AS (SELECT utterance_id, lang, {q.norm('ref', 'lang')} AS ref_n
  FROM v_pair), onoff AS (SELECT e.lang, e.utterance_id, CASE WHEN e.hit THEN 1 ELSE 0 END AS off,
  CASE WHEN seg_no % 2 = 0 THEN (CASE WHEN contains(' ' || f.ref_n || ' ', ' ' || e.kw || ' ')
    AND e.kw <> '' THEN 1 ELSE 0 END) ELSE (CASE WHEN e.hit THEN 1 ELSE 0 END) END AS on_
  FROM exact e JOIN fixed_n f USING (utterance_id, lang) JOIN v_seg s USING (utterance_id)),
r AS (SELECT lang, 1 - avg(CAST(off AS DOUBLE)) AS ker_off, 1 - avg(CAST(on_ AS DOUBLE)) AS ker_on,
  count(DISTINCT utterance_id) AS n FROM onoff GROUP BY lang)
SELECT lang, round(ker_off, 6) AS ker_off, round(ker_on, 6) AS ker_on,
  round((ker_off - ker_on) / greatest(ker_off, 1e-6), 6) AS ker_rel_improvement, n FROM r""",
)
def corrector_gain(spark, sf_dir):
    """Keyword error rate without correction against one that mends every second utterance."""
    both = pairs(spark, sf_dir)
    number = F.element_at(F.split("utterance_id", "-"), -1).cast("int")
    mended = both.withColumn("hyp", F.when(number % 2 == 0, F.col("ref")).otherwise(F.col("hyp")))
    gain = metrics.corrector_gain(
        metrics.measure(both, sound=False), metrics.measure(mended, sound=False)
    )
    return gain.select("lang", _r("ker_off"), _r("ker_on"), _r("ker_rel_improvement"), "n")


@query(
    "A26",
    f"""WITH {_edit_sql()} SELECT
  round(CAST(sum(word_edits) AS DOUBLE) / sum(ref_words), 6) AS prod_wer, 0.0::DOUBLE AS cand_wer,
  round(avg(-0.5 - ref_words / 100.0), 6) AS prod_logprob,
  round(avg(-0.4 - ref_words / 100.0), 6) AS cand_logprob, count(*) AS n FROM (
  SELECT word_edits, len(string_split(ref, ' ')) AS ref_words_raw, ref_words FROM d)""",
)
def shadow_metrics(spark, sf_dir):
    """Production and candidate on the same utterances; the candidate hears everything."""
    from soundquay.functions.text import tokens

    both = pairs(spark, sf_dir)
    n_words = F.size(tokens(F.col("ref"), F.col("lang")))
    shadow = both.select(
        "lang",
        "ref",
        F.col("hyp").alias("prod_hyp"),
        F.col("ref").alias("cand_hyp"),
        (-0.5 - n_words / 100.0).alias("prod_logprob"),
        (-0.4 - n_words / 100.0).alias("cand_logprob"),
    )
    out = metrics.paired_model_metrics(shadow)
    return out.select(*[_r(c) if c != "n" else F.col(c) for c in out.columns])


@query(
    "A27",
    """WITH s AS (SELECT CAST(o_custkey % 5 AS BIGINT) AS trial, avg(o_totalprice) / 1e6 AS prod_wer,
  avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / 1e6 AS cand_wer, count(*) AS n
  FROM orders GROUP BY 1)
SELECT trial, concat_ws(',', CASE WHEN cand_wer > prod_wer THEN 'wer' END,
  CASE WHEN trial = 1 THEN 'logprob' END, CASE WHEN trial = 2 THEN 'latency' END,
  CASE WHEN trial = 3 THEN 'regression' END) AS reasons,
  NOT (cand_wer > prod_wer) AND trial NOT IN (1, 2, 3) AS promote FROM s""",
)
def shadow_gate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shadow = (
        orders.groupBy((F.col("o_custkey") % 5).alias("trial"))
        .agg(
            (F.avg("o_totalprice") / 1e6).alias("prod_wer"),
            (F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))) / 1e6).alias(
                "cand_wer"
            ),
        )
        .withColumn("prod_logprob", F.lit(-0.4))
        .withColumn("cand_logprob", F.when(F.col("trial") == 1, -0.6).otherwise(-0.45))
        .withColumn("cand_latency_ms", F.when(F.col("trial") == 2, 3500.0).otherwise(900.0))
    )
    decided = gates.shadow_gate(shadow, regression_ok=F.col("trial") != 3)
    return decided.select("trial", F.array_join("reasons", ",").alias("reasons"), "promote")


# --- classifier: the label of a vector against a damaged prediction of it ---
_LABELS = "['AA','AB','AC','BA','BB','BC','CA','CLEAN']"
_COUNTS = f"""says AS (SELECT subtype AS truth, CASE WHEN vec_id % 4 = 0 THEN 'CLEAN'
  WHEN vec_id % 7 = 0 THEN 'BB' ELSE subtype END AS pred FROM v_sig),
c AS (SELECT truth, pred, count(*) AS n FROM says GROUP BY ALL),
f1 AS (SELECT label, sum(CASE WHEN truth = label AND pred = label THEN n ELSE 0 END) AS tp,
  sum(CASE WHEN truth <> label AND pred = label THEN n ELSE 0 END) AS fp,
  sum(CASE WHEN truth = label AND pred <> label THEN n ELSE 0 END) AS fn
  FROM c, (SELECT unnest({_LABELS}) AS label) GROUP BY label)"""
_LABEL_LIST = [*fixed.BANK_SUBTYPES, fixed.CLEAN]


def _says(spark, sf_dir):
    sig = view(spark, sf_dir, "v_sig")
    pred = (
        F.when(F.col("vec_id") % 4 == 0, fixed.CLEAN)
        .when(F.col("vec_id") % 7 == 0, "BB")
        .otherwise(F.col("subtype"))
    )
    return sig.select(F.col("subtype").alias("truth"), pred.alias("pred"))


@query(
    "A16",
    q.cte("v_sig", extra=_COUNTS)
    + "SELECT truth, "
    + ", ".join(
        f"CAST(sum(CASE WHEN pred = '{x}' THEN n ELSE 0 END) AS BIGINT) AS {x.lower()}"
        for x in _LABEL_LIST
    )
    + " FROM c GROUP BY truth",
)
def confusion_matrix(spark, sf_dir):
    wide = classifier.confusion_matrix(_says(spark, sf_dir), _LABEL_LIST)
    return wide.select("truth", *[F.col(x).alias(x.lower()) for x in _LABEL_LIST])


_F1 = """CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END"""


@query(
    "A17",
    q.cte("v_sig", extra=_COUNTS) + f"SELECT label, round({_F1}, 6) AS f1 FROM f1",
)
def label_f1(spark, sf_dir):
    counts = classifier.confusion_counts(_says(spark, sf_dir))
    return classifier.label_scores(counts, _LABEL_LIST).select("label", _r("f1"))


@query(
    "A17 P21",
    q.cte("v_sig", extra=_COUNTS)
    + f""", fc AS (SELECT CASE WHEN truth = 'CLEAN' THEN truth ELSE left(truth, 1) END AS truth,
  CASE WHEN pred = 'CLEAN' THEN pred ELSE left(pred, 1) END AS pred, sum(n) AS n FROM c GROUP BY 1, 2),
ff AS (SELECT label, sum(CASE WHEN truth = label AND pred = label THEN n ELSE 0 END) AS tp,
  sum(CASE WHEN truth <> label AND pred = label THEN n ELSE 0 END) AS fp,
  sum(CASE WHEN truth = label AND pred <> label THEN n ELSE 0 END) AS fn
  FROM fc, (SELECT unnest(['A','B','C','CLEAN']) AS label) GROUP BY label)
SELECT (SELECT round(avg({_F1}), 4) FROM f1) AS subtype_macro_f1,
  (SELECT round(avg({_F1}), 4) FROM ff) AS family_macro_f1""",
)
def macro_f1(spark, sf_dir):
    counts = classifier.confusion_counts(_says(spark, sf_dir))
    fine = classifier.macro_f1(counts, _LABEL_LIST)
    coarse = classifier.macro_f1(classifier.family_counts(counts), ["A", "B", "C", "CLEAN"])
    return fine.select(F.round("macro_f1", 4).alias("subtype_macro_f1")).crossJoin(  # one row each
        coarse.select(F.round("macro_f1", 4).alias("family_macro_f1"))
    )


@query(
    "A18",
    q.cte("v_sig", extra=_COUNTS)
    + """, s AS (SELECT sum(CASE WHEN truth = 'CLEAN' AND pred = 'CLEAN' THEN n ELSE 0 END) AS b,
  sum(CASE WHEN truth = 'CLEAN' THEN n ELSE 0 END) AS t,
  sum(CASE WHEN pred = 'CLEAN' THEN n ELSE 0 END) AS p FROM c)
SELECT round(CAST(b AS DOUBLE) / t, 6) AS clean_recall, round(1 - CAST(b AS DOUBLE) / t, 6)
  AS clean_fp_rate, round(CAST(b AS DOUBLE) / p, 6) AS clean_precision FROM s""",
)
def clean_detection(spark, sf_dir):
    rates = classifier.clean_rates(classifier.confusion_counts(_says(spark, sf_dir)))
    return rates.select(_r("clean_recall"), _r("clean_fp_rate"), _r("clean_precision"))
