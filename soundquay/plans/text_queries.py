"""Text forms, guard, menu terms, fuzzy lexicon, rules and correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay.functions import guard as g
from soundquay.functions import text as t
from soundquay.operators import correction, intervals, lexicon, terms
from soundquay.operators.metrics import false_correction_rate
from soundquay.operators.operations import stage_total
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.views import raw_utterances, segments, spread, table, utterances, view
from soundquay.sources.constants import constant_table


@query(
    "P1 P2",
    f"""WITH n AS (SELECT doc_id, {q.norm('text', 'lang')} AS norm FROM documents
  WHERE lang IN ('es', 'en'))
SELECT doc_id, md5(norm) AS norm_md5, CAST(length(norm) AS BIGINT) AS n_chars,
  CAST(CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS BIGINT) AS n_tokens
  FROM n""",
)
def normalized_texts(spark, sf_dir):
    docs = spread(view(spark, sf_dir, "v_utt"))
    norm = docs.select("doc_id", t.normalize(F.col("text"), F.col("lang")).alias("norm"))
    return norm.select(
        "doc_id",
        F.md5(F.col("norm").cast("binary")).alias("norm_md5"),
        F.length("norm").cast("long").alias("n_chars"),
        F.size(t.split_words(F.col("norm"))).cast("long").alias("n_tokens"),
    )


@query(
    "P3",
    "SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents",
)
def folded_texts(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", F.md5(t.fold_diacritics(F.col("text")).cast("binary")).alias("folded_md5")
    )


def _vocabulary_sql(lang: str) -> str:
    return f"""words AS (SELECT DISTINCT unnest(string_split({q.norm('text', 'lang')}, ' ')) AS word
  FROM documents WHERE lang = '{lang}'), vocab AS (SELECT word FROM words WHERE word <> '')"""


def _vocabulary(spark, sf_dir, lang):
    docs = spread(table(spark, sf_dir, "documents").filter(F.col("lang") == lang))
    return docs.select(
        F.explode(t.tokens(F.col("text"), F.col("lang"))).alias("word")
    ).distinct()


@query(
    "P4 P6",
    f"WITH {_vocabulary_sql('es')} SELECT word, {q.es_key('word')} AS sound FROM vocab",
)
def spanish_sound_keys(spark, sf_dir):
    words = _vocabulary(spark, sf_dir, "es")
    return words.select("word", t.phonetic_key(F.col("word"), F.lit("es")).alias("sound"))


_EN_CODE, _EN_PLAIN = q.en_key("word")


@query(
    "P5 P6 F4",
    f"""WITH {_vocabulary_sql('en')}, keyed AS (SELECT word, {_EN_CODE} AS code,
  {_EN_PLAIN} AS plain FROM vocab)
SELECT word, CASE WHEN coalesce(code, '') = '' THEN upper(replace(plain, 'ß', 'ss')) ELSE code END AS sound
  FROM keyed""",  # DuckDB's upper has no mapping to two letters: of folded letters only ß (SS) has one
)
def english_sound_keys(spark, sf_dir):
    words = _vocabulary(spark, sf_dir, "en")
    return words.select("word", F.upper(t.phonetic_key(F.col("word"), F.lit("en"))).alias("sound"))


@query(
    "P7",
    q.cte("v_tel")
    + """SELECT trace_id, CASE WHEN speech_ratio < 0.2 THEN '' ELSE noise_pred END AS text,
  CASE WHEN speech_ratio < 0.2 THEN 'es' ELSE 'en' END AS language,
  CASE WHEN speech_ratio < 0.2 THEN 'low_speech_gated' ELSE '' END AS flags,
  speech_ratio < 0.2 AS gated FROM v_tel""",
)
def low_speech_gate(spark, sf_dir):
    tel = view(spark, sf_dir, "v_tel").select(
        "trace_id",
        "speech_ratio",
        F.col("noise_pred").alias("text"),
        F.lit("en").alias("language"),
        F.array().cast("array<string>").alias("guard_flags"),
    )
    return g.gate_low_speech(tel).select(
        "trace_id", "text", "language", F.array_join("guard_flags", ",").alias("flags"), "gated"
    )


_TR = f"""{q.SEG}, v_s AS (
  SELECT doc_id, lang, seg_no, seg_no * 2.0 AS s_start, seg_no * 2.0 + 1.5 AS s_end,
    array_to_string(words, ' ') || CASE WHEN (seg_no + doc_id) % 50 = 3 THEN
      repeat(' ' || array_to_string(list_slice(words, 1, 3), ' '), 4) ELSE '' END AS text,
    -((doc_id * 7 + seg_no) % 30) / 10.0 AS avg_logprob,
    ((doc_id + seg_no * 3) % 20) / 20.0 AS no_speech_prob FROM v_win),
v_v AS (SELECT doc_id, i * 6.0 AS v_start, i * 6.0 + 3.0 + (doc_id % 3) AS v_end FROM (
  SELECT doc_id, unnest(range(0, max(seg_no) + 1)) AS i FROM v_win GROUP BY doc_id)),
spoken AS (SELECT * FROM v_s WHERE NOT (no_speech_prob > 0.85 AND avg_logprob < -1.0)),
heard AS (SELECT s.* FROM spoken s WHERE EXISTS (SELECT 1 FROM v_v v
  WHERE v.doc_id = s.doc_id AND s.s_start < v.v_end AND s.s_end > v.v_start))"""


@query(
    "P8",
    f"""WITH {_TR} SELECT doc_id, round(least(1.0, sum(v_end - v_start) / (7.0 * count(*))), 6)
  AS speech_ratio FROM v_v GROUP BY doc_id""",
)
def speech_ratios(spark, sf_dir):
    tr = segments(spark, sf_dir)
    return tr.select(
        "doc_id",
        F.round(g.speech_ratio(F.col("vad"), F.size("segments") * 7.0), 6).alias("speech_ratio"),
    )


@query(
    "P9",
    """SELECT event_id, CASE
  WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'es' END
  WHEN event_id % 7 >= 3 THEN 'es' ELSE 'en' END AS lang FROM events""",
)
def language_clamp(spark, sf_dir):
    """Even odds go to Spanish; a detected third language without odds does too."""
    events = table(spark, sf_dir, "events")
    odds = F.when(
        F.col("event_id") % 5 != 0,
        F.create_map(
            F.lit("es"), (F.col("event_id") % 7) / 6.0,
            F.lit("en"), 1.0 - (F.col("event_id") % 7) / 6.0,
            F.lit("fr"), F.lit(0.9),
        ),
    )
    detected = F.when(F.col("event_id") % 3 == 0, "en").otherwise("fr")
    return events.select("event_id", g.clamp_language(odds, detected).alias("lang"))


@query(
    "P10",
    f"""WITH {_TR} SELECT s.doc_id, count(*) AS n_segments,
  CAST(count(*) FILTER (NOT (no_speech_prob > 0.85 AND avg_logprob < -1.0)) AS BIGINT) AS n_kept
  FROM v_s s GROUP BY s.doc_id""",
)
def silent_segments(spark, sf_dir):
    tr = segments(spark, sf_dir)
    return tr.select(
        "doc_id",
        F.size("segments").cast("long").alias("n_segments"),
        F.size(g.keep_spoken(F.col("segments"))).cast("long").alias("n_kept"),
    )


@query(
    "P11",
    f"""WITH {_TR}, h AS (SELECT s.doc_id, s.seg_no FROM v_s s WHERE EXISTS (SELECT 1 FROM v_v v
  WHERE v.doc_id = s.doc_id AND s.s_start < v.v_end AND s.s_end > v.v_start))
SELECT s.doc_id, CAST(count(h.seg_no) AS BIGINT) AS n_kept FROM v_s s
  LEFT JOIN h ON h.doc_id = s.doc_id AND h.seg_no = s.seg_no GROUP BY s.doc_id""",
)
def off_speech_segments(spark, sf_dir):
    tr = segments(spark, sf_dir)
    kept = g.keep_overlapping(F.col("segments"), F.col("vad"))
    return tr.select("doc_id", F.size(kept).cast("long").alias("n_kept"))


@query(
    "J3",
    f"""WITH {_TR} SELECT doc_id, seg_no FROM v_s s WHERE NOT EXISTS (SELECT 1 FROM v_v v
  WHERE v.doc_id = s.doc_id AND s.s_start < v.v_end AND s.s_end > v.v_start)""",
)
def segments_outside_speech(spark, sf_dir):
    """The flat form of the overlap test: an interval anti join by one sweep over starts and ends."""
    rows = raw_utterances(spark, sf_dir).select("doc_id", "seg_no")
    no = F.col("seg_no")
    segs = rows.withColumns({"start": no * 2.0, "end": no * 2.0 + 1.5})
    spans = rows.select("doc_id", (no * 6.0).alias("start"), (no * 6.0 + 3.0 + F.col("doc_id") % 3).alias("end"))
    return intervals.outside(segs, spans, "doc_id").select("doc_id", "seg_no")


_CUT = """(SELECT min(k) FROM (SELECT unnest(range(0, greatest(len(w) - 8, 0))) AS k)
    WHERE list_slice(w, k + 1, k + 3) = list_slice(w, k + 4, k + 6)
      AND list_slice(w, k + 1, k + 3) = list_slice(w, k + 7, k + 9))"""


@query(
    "P12",
    f"""WITH {_TR}, ws AS (SELECT doc_id, seg_no, text, string_split(text, ' ') AS w FROM v_s),
cut AS (SELECT *, {_CUT} AS cut_at FROM ws)
SELECT doc_id, seg_no, cut_at IS NOT NULL AS was_cut,
  md5(CASE WHEN cut_at IS NULL THEN text ELSE array_to_string(list_slice(w, 1, cut_at + 3), ' ') END)
    AS text_md5 FROM cut""",
)
def repetition_cut(spark, sf_dir):
    tr = segments(spark, sf_dir).select("doc_id", F.explode("segments").alias("s"))
    cut = tr.select(
        "doc_id", F.col("s.no").alias("seg_no"), g.cut_repetition(F.col("s.text")).alias("c")
    )
    return cut.select(
        "doc_id", "seg_no", "c.was_cut", F.md5(F.col("c.text").cast("binary")).alias("text_md5")
    )


@query(
    "P13 P14 P10 P11 P12",
    f"""WITH {_TR}, joined AS (SELECT d.doc_id,
    trim(coalesce(string_agg(trim(h.text), ' ' ORDER BY h.seg_no), '')) AS text
  FROM (SELECT DISTINCT doc_id FROM v_s) d LEFT JOIN heard h ON h.doc_id = d.doc_id
  GROUP BY d.doc_id),
ws AS (SELECT *, string_split(text, ' ') AS w FROM joined), cut AS (SELECT *, {_CUT} AS cut_at FROM ws),
n AS (SELECT doc_id, (SELECT count(*) FROM v_s s WHERE s.doc_id = c.doc_id) AS n_all,
   (SELECT count(*) FROM spoken s WHERE s.doc_id = c.doc_id) AS n_spoken,
   (SELECT count(*) FROM heard s WHERE s.doc_id = c.doc_id) AS n_heard, text, w, cut_at FROM cut c)
SELECT doc_id, n_heard AS n_segments,
  md5(CASE WHEN cut_at IS NULL THEN text ELSE array_to_string(list_slice(w, 1, cut_at + 3), ' ') END)
    AS text_md5,
  concat_ws(',', CASE WHEN n_spoken < n_all THEN 'low_speech_dropped' END,
    CASE WHEN n_heard < n_spoken THEN 'vad_dropped' END,
    CASE WHEN cut_at IS NOT NULL THEN 'repetition_truncated' END) AS flags,
  n_spoken < n_all OR n_heard < n_spoken OR cut_at IS NOT NULL AS fired FROM n""",
)
def transcript_guard(spark, sf_dir):
    out = g.apply_guard(segments(spark, sf_dir))
    return out.select(
        "doc_id",
        F.size("segments").cast("long").alias("n_segments"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.array_join("guard_flags", ",").alias("flags"),
        g.guard_fired(F.col("guard_flags")).alias("fired"),
    )


@query(
    "P17",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(1000 + doc_id AS VARCHAR)
  ELSE source || '_' || CAST(doc_id % 10 AS VARCHAR) END AS speaker FROM documents""",
)
def speakers_from_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    even = F.concat_ws("-", (F.col("doc_id") + 1000).cast("string"), F.lit("17"), F.lit("0001"))
    odd = F.concat_ws(
        "_", "source", (F.col("doc_id") % 10).cast("string"), F.col("doc_id").cast("string")
    )
    path = F.concat(
        F.lit("clean/x/"), F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd), F.lit(".wav")
    )
    return docs.select("doc_id", t.speaker_id(path).alias("speaker"))


@query(
    "P19",
    q.cte("v_tel")
    + """SELECT trace_id, round(CASE WHEN speech_ratio < 0.2 THEN total_ms / 10 ELSE
  total_ms / 10 + CASE WHEN trace_id % 3 = 0 THEN 0 ELSE total_ms / 5 END + total_ms / 2 END, 4)
  AS total_ms FROM v_tel""",
)
def stage_totals(spark, sf_dir):
    tel = view(spark, sf_dir, "v_tel")
    total = stage_total(
        g.is_gated(F.col("speech_ratio")),
        {
            "vad": F.col("total_ms") / 10,
            "preprocess": F.when(F.col("trace_id") % 3 != 0, F.col("total_ms") / 5),
            "asr": F.col("total_ms") / 2,
            "keydetector": F.lit(None).cast("double"),
        },
    )
    return tel.select("trace_id", F.round(total, 4).alias("total_ms"))


@query(
    "P20",
    f"""WITH {q.SEG}, w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM v_seg)
SELECT word, CASE WHEN word = upper(word) AND word <> lower(word) THEN 'TENEDOR'
  WHEN substr(word, 1, 1) = upper(substr(word, 1, 1))
   AND substr(word, 1, 1) <> lower(substr(word, 1, 1)) THEN 'Tenedor' ELSE 'tenedor' END AS cased
  FROM w""",
)
def case_transfer(spark, sf_dir):
    words = utterances(spark, sf_dir).select(F.explode(t.raw_words(F.col("text"))).alias("word"))
    return words.distinct().select(
        "word", t.match_case(F.col("word"), F.lit("tenedor")).alias("cased")
    )


@query(
    "P21",
    q.cte("v_sig")
    + """SELECT CASE WHEN subtype = 'CLEAN' THEN 'CLEAN' ELSE substr(subtype, 1, 1) END AS family,
  count(*) AS n FROM v_sig GROUP BY 1""",
)
def noise_families(spark, sf_dir):
    sig = view(spark, sf_dir, "v_sig")
    return sig.groupBy(t.family(F.col("subtype")).alias("family")).agg(
        F.count(F.lit(1)).alias("n")
    )


_TERMS = """first AS (SELECT lang, term, ord FROM (SELECT *, row_number() OVER (
  PARTITION BY lang, lower(term) ORDER BY ord) AS rn FROM v_menu) WHERE rn = 1)"""


@query("T1", q.cte("v_menu", extra=_TERMS) + "SELECT lang, ord, term FROM first")
def menu_terms(spark, sf_dir):
    return terms.menu_terms(view(spark, sf_dir, "v_menu"))


_BUDGET = 40


@query(
    "T2",
    q.cte("v_menu", extra=_TERMS)
    + f"""SELECT lang, string_agg(term, ', ' ORDER BY ord) AS prompt FROM (
  SELECT *, sum(len(string_split(term, ' '))) OVER (PARTITION BY lang ORDER BY ord) AS spent
  FROM first) WHERE spent <= {_BUDGET} GROUP BY lang""",
)
def initial_prompts(spark, sf_dir):
    return terms.initial_prompt(view(spark, sf_dir, "v_menu"), _BUDGET)


@query(
    "T3",
    q.cte("v_menu", extra=_TERMS)
    + f""", turns AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ord) AS turn,
  CASE lang WHEN 'es' THEN 0 ELSE 1 END AS side FROM first),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(term)
  ORDER BY turn, side) AS rn FROM turns) WHERE rn = 1)
SELECT string_agg(term, ', ' ORDER BY turn, side) AS prompt FROM (
  SELECT *, sum(len(string_split(term, ' '))) OVER (ORDER BY turn, side) AS spent FROM uniq)
  WHERE spent <= {_BUDGET}""",
)
def bilingual_prompt(spark, sf_dir):
    return terms.bilingual_prompt(view(spark, sf_dir, "v_menu"), _BUDGET)


_LEX = f"""lex AS (SELECT lang, norm, ord, canonical, len(string_split(norm, ' ')) AS n FROM (
  SELECT lang, {q.norm('term', 'lang')} AS norm, ord, canonical, row_number() OVER (
    PARTITION BY lang, {q.norm('term', 'lang')} ORDER BY ord) AS rn FROM v_menu)
  WHERE rn = 1 AND norm <> '' AND len(string_split(norm, ' ')) <= 3)"""


@query(
    "T4",
    q.cte("v_menu", extra=_LEX)
    + "SELECT lang, norm, ord, canonical, CAST(n AS BIGINT) AS n FROM lex",
)
def lexicon_table(spark, sf_dir):
    lex = terms.lexicon(view(spark, sf_dir, "v_menu"), with_key=False)
    return lex.select("lang", "norm", "ord", "canonical", F.col("n").cast("long").alias("n"))


@query(
    "J2",
    f"""WITH t AS ({q.VIEWS['v_term'].sql()}),
pair AS (SELECT a.corrupted AS gram, b.term, length(a.corrupted) + length(b.term) AS total,
    length(a.corrupted) + length(b.term) - 2 * {q.lcs('a.corrupted', 'b.term')} AS d
  FROM (SELECT DISTINCT corrupted FROM t) a, (SELECT DISTINCT term FROM t) b
  WHERE abs(length(a.corrupted) - length(b.term)) <= 3 AND a.corrupted <> b.term),
best AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY CAST(d AS DOUBLE) / total, term)
    AS rn FROM pair WHERE 100 * d <= 10 * total)
SELECT gram, term AS canonical, round(1.0 - CAST(d AS DOUBLE) / total, 3) AS confidence
  FROM best WHERE rn = 1""",
)
def fuzzy_terms(spark, sf_dir):
    """Most similar menu term of each damaged spelling."""
    spelled = view(spark, sf_dir, "v_term")
    lex = spelled.select(
        F.lit("en").alias("lang"),
        F.lit(2).alias("n"),
        F.col("term").alias("norm"),
        F.col("term").alias("ord"),
        F.col("term").alias("canonical"),
    ).distinct()
    grams = spelled.select(F.lit("en").alias("lang"), F.lit(2).alias("n"), F.col("corrupted").alias("gram"))
    return lexicon.best_terms(grams, lex).select("gram", "canonical", "confidence")


# orders said over a bad line: the item is damaged in every third line
_SAID = """said AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
  || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' ||
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS uid, l_linenumber,
  CASE WHEN l_linenumber % 3 = 0 THEN substr(p_name, 1, 2) || substr(p_name, 4) ELSE p_name END
    AS item,
  CASE WHEN l_linenumber % 4 = 0 THEN 'some flies' WHEN l_linenumber % 4 = 1 THEN 'Flies swarm'
    ELSE 'a folk' END AS side
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _said(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.col("p_name")
    item = F.when(
        F.col("l_linenumber") % 3 == 0, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 99))
    ).otherwise(name)
    side = (
        F.when(F.col("l_linenumber") % 4 == 0, "some flies")
        .when(F.col("l_linenumber") % 4 == 1, "Flies swarm")
        .otherwise("a folk")
    )
    return (
        spread(line)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"
            ).alias("uid"),
            F.lit("en").alias("lang"),
            F.concat(F.lit("order "), item, F.lit(" with  "), side, F.lit(" please")).alias("text"),
        )
    )


def _part_lexicon(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(
        F.lit("en").alias("lang"),
        F.lit(2).alias("n"),
        F.col("p_name").alias("norm"),
        F.col("p_name").alias("ord"),
        F.col("p_name").alias("canonical"),
    )


# --- fixed values: rules over the spoken orders ---
_RULES = [
    (0, "en-0003", "en", "flies", "fries", ["and", "order", "some"], ["swarm", "bug"], "active"),
    (1, "en-0002", "en", "folk", "fork", ["a", "knife"], ["music"], "approved"),
]


def _rules(spark):
    return constant_table(
        spark,
        _RULES,
        "rule_ord int, id string, lang string, wrong string, right string, "
        "context_any array<string>, context_none array<string>, status string",
    )


# all two-word groups of the said orders that are near a part name, found by full comparison
_FUZZY = f"""names AS (SELECT DISTINCT p_name AS term FROM part),
uniq AS (SELECT DISTINCT uid, item, side FROM said),
words AS (SELECT uid, item, side,
  string_split(lower('order ' || item || ' with ' || side || ' please'), ' ') AS w FROM uniq),
bigrams AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS gram FROM (
  SELECT w, unnest(range(1, len(w))) AS i FROM words)),
near AS (SELECT gram, term, CAST(d AS DOUBLE) / total AS far, row_number() OVER (PARTITION BY gram
    ORDER BY CAST(d AS DOUBLE) / total, term) AS rn FROM (
  SELECT gram, term, length(gram) + length(term) AS total,
    length(gram) + length(term) - 2 * {q.lcs('gram', 'term')} AS d FROM bigrams, names
   WHERE abs(length(gram) - length(term)) <= 3 AND gram NOT IN (SELECT term FROM names))
  WHERE 100 * d <= 10 * total),
fix AS (SELECT gram, term, round(1 - far, 3) AS confidence FROM near WHERE rn = 1),
-- the item takes words 2 and 3; no other word group is near a name
hit AS (SELECT u.uid, u.item, u.side, f.term, f.confidence FROM uniq u LEFT JOIN fix f
  ON f.gram = u.item)"""


@query(
    "K1 T4",
    f"""WITH {_SAID}, {_FUZZY} SELECT uid, CAST(1 AS BIGINT) AS start, item AS before,
  term AS after, confidence FROM hit WHERE term IS NOT NULL""",
)
def lexicon_corrections(spark, sf_dir):
    out = correction.correct(
        _said(spark, sf_dir), _part_lexicon(spark, sf_dir), None, "replace", key="uid"
    )
    return out.select("uid", F.inline("corrections")).select(
        "uid", F.col("start").cast("long").alias("start"), "before", "after", "confidence"
    )


@query(
    "J12 K2 K4",
    f"""WITH {_SAID}, uniq AS (SELECT DISTINCT uid, item, side FROM said)
SELECT uid, CASE WHEN side LIKE '%lies%' THEN 'en-0003' ELSE 'en-0002' END AS rule_id,
  CAST(CASE WHEN side = 'some flies' OR side = 'a folk' THEN len(string_split(item, ' ')) + 3
    END AS BIGINT) AS start,
  CASE WHEN side LIKE '%lies%' THEN 'flies' ELSE 'folk' END AS before,
  CASE WHEN side LIKE '%lies%' THEN 'fries' ELSE 'fork' END AS after
  FROM uniq WHERE side <> 'Flies swarm'""",
)
def rule_matches(spark, sf_dir):
    """Rules fire in the right context only: the swarm of flies stays."""
    out = correction.correct(_said(spark, sf_dir), None, _rules(spark), "log_only", key="uid")
    return out.select("uid", F.inline("corrections")).select(
        "uid", "rule_id", F.col("start").cast("long").alias("start"), "before", "after"
    )


@query(
    "K3 K6 P15 F1",
    f"""WITH {_SAID}, {_FUZZY} SELECT uid, 'order ' || coalesce(term, item) || ' with ' ||
  CASE WHEN side = 'some flies' THEN 'some fries' ELSE side END || ' please' AS corrected,
  concat_ws(',', CASE WHEN term IS NOT NULL THEN 'lexicon' END,
    CASE WHEN side = 'some flies' THEN 'en-0003' END) AS fired FROM hit""",
)
def corrected_orders(spark, sf_dir):
    """Lexicon and active rules together in replace mode; the approved rule stays silent."""
    out = correction.correct(
        _said(spark, sf_dir), _part_lexicon(spark, sf_dir), _rules(spark), "replace", key="uid"
    )
    return out.select(
        "uid",
        "corrected",
        F.array_join(F.transform("corrections", lambda c: c["rule_id"]), ",").alias("fired"),
    )


@query(
    "P15",
    f"""WITH {_SAID}, {_FUZZY} SELECT uid, 'order ' || item || ' with  ' || side || ' please'
  AS corrected, CAST((CASE WHEN term IS NULL THEN 0 ELSE 1 END)
    + (CASE WHEN side = 'Flies swarm' THEN 0 ELSE 1 END) AS BIGINT) AS n_corrections FROM hit""",
)
def logged_corrections(spark, sf_dir):
    """The same in log mode: text byte for byte as it was, corrections noted."""
    out = correction.correct(
        _said(spark, sf_dir), _part_lexicon(spark, sf_dir), _rules(spark), "log_only", key="uid"
    )
    return out.select(
        "uid", "corrected", F.size("corrections").cast("long").alias("n_corrections")
    )


@query(
    "A15",
    f"""WITH {_SAID}, {_FUZZY} SELECT 'en' AS lang, count(*) AS n_texts,
  CAST(count(*) FILTER (term IS NOT NULL OR side = 'some flies') AS BIGINT) AS n_corrected,
  round(avg(CASE WHEN term IS NOT NULL OR side = 'some flies' THEN 1.0 ELSE 0.0 END), 6)
    AS false_correction_rate FROM hit""",
)
def correction_share(spark, sf_dir):
    out = correction.correct(
        _said(spark, sf_dir), _part_lexicon(spark, sf_dir), _rules(spark), "replace", key="uid"
    )
    return false_correction_rate(out).withColumn(
        "false_correction_rate", F.round("false_correction_rate", 6)
    )


@query(
    "K5",
    f"""WITH {q.SEG} SELECT utterance_id, md5(text) AS text_md5, CAST(0 AS BIGINT) AS n_corrections
  FROM v_seg""",
)
def passthrough_correction(spark, sf_dir):
    """The control arm: no lexicon, no rules, the text unchanged."""
    out = utterances(spark, sf_dir).transform(correction.correct)
    return out.select(
        "utterance_id",
        F.md5(F.col("corrected").cast("binary")).alias("text_md5"),
        F.size("corrections").cast("long").alias("n_corrections"),
    )


@query(
    "K6",
    f"""WITH {_TR}, joined AS (SELECT d.doc_id,
    trim(coalesce(string_agg(trim(h.text), ' ' ORDER BY h.seg_no), '')) AS text
  FROM (SELECT DISTINCT doc_id FROM v_s) d LEFT JOIN heard h ON h.doc_id = d.doc_id
  GROUP BY d.doc_id),
ws AS (SELECT *, string_split(text, ' ') AS w FROM joined), cut AS (SELECT doc_id,
  CASE WHEN {_CUT} IS NULL THEN text ELSE array_to_string(list_slice(w, 1, {_CUT} + 3), ' ') END
    AS text FROM ws),
gated AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS text FROM cut),
toks AS (SELECT doc_id, string_split(text, ' ') AS w FROM gated),
found AS (SELECT doc_id, w, (SELECT min(k) FROM (SELECT unnest(range(1, len(w) + 1)) AS k)
  WHERE trim(regexp_replace(lower(w[k]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) = 'que') AS k FROM toks)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda v, i: CASE WHEN i = k THEN
    CASE WHEN v = upper(v) THEN 'QUEDA' WHEN left(v, 1) = 'Q' THEN 'Queda' ELSE 'queda' END
    ELSE v END), ' ')) AS text_md5,
  CAST(CASE WHEN k IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_corrections FROM found""",
)
def cleaned_transcripts(spark, sf_dir):
    """Gate, guard and correction in one pass over whole transcripts."""
    tr = segments(spark, sf_dir).withColumn("lang", F.lit("es"))
    guarded = g.apply_guard(tr).withColumn(
        "speech_ratio", F.when(F.col("doc_id") % 10 == 0, 0.1).otherwise(0.9)
    )
    gated = g.gate_low_speech(guarded.withColumn("language", F.col("lang")))
    rules = constant_table(
        spark,
        [(0, "es-9001", "es", "que", "queda", [], [], "active")],
        "rule_ord int, id string, lang string, wrong string, right string, "
        "context_any array<string>, context_none array<string>, status string",
    )
    out = correction.correct(gated, None, rules, "replace", key="doc_id")
    return out.select(
        "doc_id",
        F.md5(F.col("corrected").cast("binary")).alias("text_md5"),
        F.size("corrections").cast("long").alias("n_corrections"),
    )


