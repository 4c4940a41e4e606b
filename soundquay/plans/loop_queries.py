"""Feedback loop: harvest, routing, mining, rule lifecycle, profiles, the cycle as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.operators import feedback, gates, metrics, mining
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.views import pairs, table, utterances, view
from soundquay.sources.stage import stage_table, work_folder

_ROUTED = """routed AS (SELECT transcription_id, CASE WHEN verdict = 'correct' AND order_core_match
  THEN 'training' WHEN verdict = 'minor_errors' AND coalesce(corrected_reference, '') <> ''
  AND confidence >= 0.8 THEN 'training+miner' ELSE 'review' END AS route FROM v_verdict)"""


def _routed(spark, sf_dir):
    verdicts = view(spark, sf_dir, "v_verdict")
    return verdicts.withColumn(
        "route",
        feedback.route(
            F.col("verdict"),
            F.col("corrected_reference"),
            F.col("order_core_match"),
            F.col("confidence"),
        ),
    )


@query("P16", q.cte("v_verdict", extra=_ROUTED) + "SELECT transcription_id, route FROM routed")
def verdict_routes(spark, sf_dir):
    return _routed(spark, sf_dir).select("transcription_id", "route")


@query(
    "A32",
    q.cte("v_verdict", extra=_ROUTED)
    + """SELECT r.route, count(routed.route) AS n FROM (SELECT unnest(['training',
  'training+miner', 'review']) AS route) r LEFT JOIN routed USING (route) GROUP BY r.route""",
)
def route_counts(spark, sf_dir):
    return feedback.route_counts(_routed(spark, sf_dir))


@query(
    "J13 F2",
    f"""WITH {q.pair_cte()}, script AS (SELECT text AS transcript, min(item_id) AS item_id
  FROM benchmark GROUP BY text), s AS (SELECT utterance_id, ref FROM v_pair)
SELECT utterance_id, CASE WHEN seg_mod = 0 THEN 'wrong' ELSE 'correct' END AS verdict,
  CASE WHEN seg_mod = 0 THEN 0.4 ELSE 0.95 END::DOUBLE AS confidence FROM (
  SELECT p.utterance_id, CASE WHEN EXISTS (SELECT 1 FROM v_pair d WHERE d.ref = p.ref
    AND d.guard_fired) THEN 0 ELSE 1 END AS seg_mod FROM v_pair p)""",
)
def scripted_verdicts(spark, sf_dir):
    """Known transcripts (those of suspect windows) get the scripted verdict, others the default."""
    both = pairs(spark, sf_dir)
    requests = both.select("utterance_id", F.col("ref").alias("transcript"))
    script = (
        both.filter("guard_fired")
        .select(F.col("ref").alias("transcript"))
        .distinct()
        .withColumn("verdict", F.lit("wrong"))
        .withColumn("confidence", F.lit(0.4))
    )
    default = {"verdict": "correct", "confidence": 0.95}
    return feedback.scripted_verdicts(requests, script, default).select(
        "utterance_id", "verdict", "confidence"
    )


@query(
    "J14 P26",
    q.cte("v_menu", "v_ticket")
    + """, items AS (SELECT string_agg(term, ';' ORDER BY ord) AS menu_items FROM (
  SELECT * FROM v_menu WHERE lang = 'es' ORDER BY ord LIMIT 60))
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, t.items AS pos_ticket,
  md5(i.menu_items) AS menu_md5 FROM events e LEFT JOIN v_ticket t
  ON t.order_id = json_extract_string(props, '$.k'), items i""",
)
def judge_requests(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.replace("props", F.lit('"k"'), F.lit('"pos_order_id"')).alias("meta_json")
    )
    menu = view(spark, sf_dir, "v_menu").filter(F.col("lang") == "es")
    out = feedback.judge_requests(events, view(spark, sf_dir, "v_ticket"), menu)
    return out.select(
        "event_id",
        F.col("order_id").cast("long").alias("k"),
        "pos_ticket",
        F.md5(F.array_join("menu_items", ";").cast("binary")).alias("menu_md5"),
    )


# transcriptions: events; corrections: order lines by event; verdicts: labels, two per document
_EVIDENCE = """tr AS (SELECT event_id AS transcription_id, 'utt-' || lpad(CAST(event_id AS VARCHAR),
  9, '0') AS utterance_id, -(value / 100.0) AS avg_logprob, event_id % 10 = 0 AS flagged FROM events),
co AS (SELECT l_orderkey AS transcription_id, count(*) AS n FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1),
ve AS (SELECT doc_id AS transcription_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'wrong'
  ELSE 'correct' END AS verdict FROM labels),
ev AS (SELECT tr.*, coalesce(co.n, 0) AS n_rules, ve.verdict FROM tr LEFT JOIN co
  USING (transcription_id) LEFT JOIN ve USING (transcription_id))"""


def _evidence(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transcription_id"),
        F.concat(F.lit("utt-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("utterance_id"),
        (-(F.col("value") / 100.0)).alias("avg_logprob"),
        F.when(F.col("event_id") % 10 == 0, F.array(F.lit("vad_dropped")))
        .otherwise(F.array().cast("array<string>"))
        .alias("guard_flags"),
    )
    corrections = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(F.col("l_orderkey").alias("transcription_id"))
    )
    labels = table(spark, sf_dir, "labels")
    wrong = (F.col("quality") == 0) & (F.col("toxic") == 0)
    last = labels.select(
        F.col("doc_id").alias("transcription_id"),
        (F.col("doc_id") * 2 + 1).alias("id"),
        F.when(wrong, "wrong").otherwise("correct").alias("verdict"),
    )
    # an older verdict that the last one overrules
    first = last.select(
        "transcription_id", (F.col("id") - 1).alias("id"), F.lit("hallucination").alias("verdict")
    )
    return feedback.evidence_join(events, corrections, first.unionByName(last))


@query(
    "J1 W15",
    f"WITH {_EVIDENCE} SELECT transcription_id, n_rules, verdict FROM ev",
)
def transcription_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("transcription_id", "n_rules", "verdict")


_REASONS = """reasons AS (SELECT *, concat_ws(',', CASE WHEN avg_logprob < -0.6 THEN 'low_logprob' END,
  CASE WHEN flagged THEN 'guard_flags' END, CASE WHEN n_rules >= 2 THEN 'rules_fired' END,
  CASE WHEN verdict = 'wrong' THEN 'judge_wrong' END) AS reasons FROM ev)"""


@query(
    "A31",
    f"WITH {_EVIDENCE}, {_REASONS} SELECT transcription_id, reasons FROM reasons",
)
def harvest_reasons(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    return evidence.select(
        "transcription_id", F.array_join(feedback.harvest_reasons(), ",").alias("reasons")
    )


_HARVEST = f"""rest AS (SELECT utterance_id, row_number() OVER (ORDER BY
  md5('{fixed.SEED}|' || utterance_id), utterance_id) AS rn, round_even(count(*) OVER () * 0.02, 0) AS k
  FROM reasons WHERE reasons = ''),
work AS (SELECT utterance_id, transcription_id, reasons FROM reasons WHERE reasons <> ''
  UNION ALL SELECT utterance_id, NULL, 'control' FROM rest WHERE rn <= k)"""


@query(
    "W9 W10 A31",
    f"""WITH {_EVIDENCE}, {_REASONS}, {_HARVEST} SELECT * FROM work
  ORDER BY utterance_id, reasons LIMIT 500""",
)
def harvest_worklist(spark, sf_dir):
    """The capped weekly list, in its fixed order."""
    return feedback.harvest(_evidence(spark, sf_dir))


@query(
    "W9 A31",
    f"WITH {_EVIDENCE}, {_REASONS}, {_HARVEST} SELECT * FROM work",
)
def harvest_all(spark, sf_dir):
    """The whole list without the cap."""
    return feedback.harvest(_evidence(spark, sf_dir), cap=None)


# Edit distances of the words between common head and tail, column by column, and the walk back from
# the end: a deletion where it is optimal, an insertion where the diagonal is worse, the diagonal.
_SUBS = f"""{q.pair_cte()},
n AS (SELECT utterance_id, lang, {q.norm('ref', 'lang')} AS ref_n, {q.norm('hyp', 'lang')} AS hyp_n,
  hyp FROM v_pair),
whole AS (SELECT utterance_id, string_split(ref_n, ' ') AS r, string_split(hyp_n, ' ') AS h FROM n
  WHERE ref_n <> '' AND hyp_n <> '' AND ref_n <> hyp_n),
headed AS (SELECT *, least(len(r), len(h)) AS most, coalesce(list_position(list_transform(
  range(1, least(len(r), len(h)) + 1), lambda i: r[i] = h[i]), false) - 1, least(len(r), len(h))) AS head FROM whole),
tailed AS (SELECT *, coalesce(list_position(list_transform(range(0, most - head),
  lambda i: r[len(r) - i] = h[len(h) - i]), false) - 1, most - head) AS tail FROM headed),
mid AS (SELECT utterance_id, head, r[head + 1:len(r) - tail] AS rw, h[head + 1:len(h) - tail] AS hw FROM tailed
  WHERE len(r) > head + tail AND len(h) > head + tail),
col AS (SELECT utterance_id, 0 AS j, range(0, len(rw) + 1) AS d FROM mid
  UNION ALL SELECT utterance_id, j, list_transform(range(0, len(c)), lambda i: list_min(c[1:i + 1]) + i) FROM (
    SELECT m.utterance_id, j + 1 AS j, list_prepend(j + 1, list_transform(range(1, len(rw) + 1),
      lambda i: least(d[i + 1] + 1, d[i] + CASE WHEN rw[i] = hw[j + 1] THEN 0 ELSE 1 END) - i)) AS c
    FROM col JOIN mid m USING (utterance_id) WHERE j < len(hw))),
walk AS (SELECT utterance_id, len(rw) AS i, len(hw) AS j, len(rw) AS i0, 0 AS step FROM mid
  UNION ALL SELECT utterance_id, CASE WHEN step = 2 THEN i ELSE i - 1 END, CASE WHEN step = 1 THEN j ELSE j - 1 END,
    i AS i0, step FROM (SELECT w.utterance_id, w.i, w.j, CASE WHEN c.d[w.i + 1] = c.d[w.i] + 1 THEN 1
      WHEN p.d[w.i + 1] = p.d[w.i] - 1 THEN 2 ELSE 3 END AS step
    FROM walk w JOIN col c ON c.utterance_id = w.utterance_id AND c.j = w.j
      JOIN col p ON p.utterance_id = w.utterance_id AND p.j = w.j - 1 WHERE w.i > 0 AND w.j > 0)),
subs AS (SELECT utterance_id, lang, head + j AS place, hyp, hw[j + 1] AS wrong, rw[i + 1] AS right_
  FROM walk JOIN mid USING (utterance_id) JOIN n USING (utterance_id) WHERE step = 3 AND hw[j + 1] <> rw[i + 1])"""


@query(
    "A28 F5",
    f"""WITH RECURSIVE {_SUBS} SELECT utterance_id, CAST(place AS BIGINT) AS place, wrong,
  right_ AS "right" FROM subs""",
)
def aligned_substitutions(spark, sf_dir):
    """Replaced words of all pairs, with inserted and dropped words between them."""
    subs = mining.substitutions(pairs(spark, sf_dir))
    return subs.select("utterance_id", "place", "wrong", "right")


def _mined_sql(subs: str) -> str:
    return f"""cnt AS (SELECT lang, wrong, right_, count(*) AS evidence FROM {subs} GROUP BY ALL),
prec AS (SELECT *, CAST(evidence AS DOUBLE) / sum(evidence) OVER (PARTITION BY lang, wrong)
  AS precision FROM cnt),
menu AS (SELECT 'x' || word AS wrong FROM (SELECT DISTINCT unnest(string_split(
  {q.norm('text', "'en'")}, ' ')) AS word FROM benchmark)),
mined AS (SELECT lang, wrong, right_, evidence, round(precision, 3) AS precision FROM prec
  WHERE evidence >= 5 AND precision >= 0.9 AND wrong NOT IN (SELECT wrong FROM menu))"""


_PAIRS = f"""{_SUBS}, {_mined_sql('subs')}"""


def _menu_words(spark, sf_dir):
    from soundquay.functions.text import tokens

    words = table(spark, sf_dir, "benchmark").select(
        F.explode(tokens(F.col("text"), F.lit("en"))).alias("word")
    )
    return words.select(
        F.explode(F.array(F.lit("es"), F.lit("en"))).alias("lang"),
        F.concat(F.lit("x"), "word").alias("term"),
    ).distinct()


def _mined(spark, sf_dir):
    both = pairs(spark, sf_dir)
    # read several times below: align once
    subs = stage_table(mining.substitutions(both), "substitutions")
    return both, subs, mining.candidates(subs, _menu_words(spark, sf_dir))


@query(
    "A28 J7",
    f"""WITH RECURSIVE {_PAIRS} SELECT lang, wrong, right_ AS "right", evidence, precision FROM mined""",
)
def mined_confusions(spark, sf_dir):
    return _mined(spark, sf_dir)[2]


_CONTEXT = f"""{_PAIRS}, ctx AS (SELECT * FROM (SELECT s.*, row_number() OVER (
  PARTITION BY s.lang, s.wrong, s.right_ ORDER BY s.utterance_id, s.place) AS rn FROM subs s
  JOIN mined m ON m.lang = s.lang AND m.wrong = s.wrong
   AND m.right_ = s.right_) WHERE rn <= 5)"""


@query(
    "A29",
    f"""WITH RECURSIVE {_CONTEXT}, w AS (SELECT c.lang, c.wrong, c.right_, c.rn, i, word FROM (
  SELECT *, generate_subscripts(hw, 1) AS i, unnest(hw) AS word FROM (SELECT c.*,
    string_split({q.norm('c.hyp', 'c.lang')}, ' ') AS hw FROM ctx c)) c WHERE word <> wrong),
t AS (SELECT lang, wrong, right_, word, count(*) AS n, min(rn * 1000 + i) AS seen FROM w GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY lang, wrong, right_ ORDER BY n DESC, seen) AS p
  FROM t)
SELECT lang, wrong, right_ AS "right", string_agg(word, ',' ORDER BY p) AS context_any FROM top
  WHERE p <= 4 GROUP BY ALL""",
)
def confusion_contexts(spark, sf_dir):
    both, subs, mined = _mined(spark, sf_dir)
    terms = mining.context_terms(mining.contexts(subs, mined, both))
    return terms.select(
        "lang", "wrong", "right", F.array_join("context_any", ",").alias("context_any")
    )


@query(
    "A30",
    f"""WITH RECURSIVE {_PAIRS} SELECT 'mined-c1-' || printf('%03d', row_number() OVER (ORDER BY evidence DESC, lang,
  wrong, right_) - 1) AS id, lang, wrong, right_ AS "right",
  'candidate' AS status, evidence AS evidence_count FROM mined""",
)
def mined_rules(spark, sf_dir):
    both, subs, mined = _mined(spark, sf_dir)
    terms = mining.context_terms(mining.contexts(subs, mined, both))
    rules = mining.rule_rows(mined, terms, "c1")
    return rules.select(
        "id", "lang", "wrong", "right", "status", F.col("provenance.evidence_count").alias("evidence_count")
    )


@query(
    "A30",
    f"""WITH RECURSIVE {_CONTEXT} SELECT lang, wrong, right_ AS "right", hyp AS input, true AS fires FROM ctx
  WHERE rn = 1 UNION ALL SELECT lang, wrong, right_, 'TODO legit use of ' || wrong, false FROM mined""",
)
def case_skeletons(spark, sf_dir):
    both, subs, mined = _mined(spark, sf_dir)
    return mining.case_skeletons(mined, mining.contexts(subs, mined, both))


@query(
    "J7",
    f"""WITH RECURSIVE {_PAIRS} SELECT lang, wrong, right_ AS "right", evidence FROM cnt
  WHERE wrong NOT IN (SELECT wrong FROM menu)""",
)
def pairs_without_menu_terms(spark, sf_dir):
    counts = mining.evidence(mining.substitutions(pairs(spark, sf_dir)))
    menu = _menu_words(spark, sf_dir).withColumnRenamed("term", "wrong")
    return counts.join(menu, ["lang", "wrong"], "left_anti").select(
        "lang", "wrong", "right", "evidence"
    )


_RULES = """rules AS (SELECT 'r-' || CAST(p_partkey AS VARCHAR) AS rule_id, CASE p_partkey % 4
  WHEN 0 THEN 'candidate' WHEN 3 THEN 'active' ELSE 'approved' END AS status FROM part),
seen AS (SELECT 'r-' || CAST(l_partkey AS VARCHAR) AS rule_id, min(l_linenumber) AS weeks_approved,
  count(*) AS correct_fires, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 47 THEN 1 ELSE 0 END)
    AS conflicts FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1),
adv AS (SELECT r.rule_id, r.status AS old_status, CASE WHEN r.status = 'approved'
  AND coalesce(weeks_approved, 0) >= 2 AND coalesce(correct_fires, 0) >= 5
  AND coalesce(conflicts, 0) = 0 THEN 'active' ELSE r.status END AS new_status
  FROM rules r LEFT JOIN seen s USING (rule_id))"""


def _advanced(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    status = (
        F.when(F.col("p_partkey") % 4 == 0, "candidate")
        .when(F.col("p_partkey") % 4 == 3, "active")
        .otherwise("approved")
    )
    rules = part.select(
        F.concat(F.lit("r-"), F.col("p_partkey").cast("string")).alias("rule_id"), status.alias("status")
    )
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_partkey") % 7 != 0)
    clash = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 47)
    seen = line.groupBy(
        F.concat(F.lit("r-"), F.col("l_partkey").cast("string")).alias("rule_id")
    ).agg(
        F.min("l_linenumber").alias("weeks_approved"),
        F.count(F.lit(1)).alias("correct_fires"),
        F.sum(clash.cast("long")).alias("conflicts"),
    )
    return feedback.advance_rules(rules, seen)


@query("A33 J15", f"WITH {_RULES} SELECT rule_id, old_status, new_status FROM adv")
def advanced_rules(spark, sf_dir):
    return _advanced(spark, sf_dir)


@query(
    "A33",
    f"WITH {_RULES} SELECT rule_id, old_status, new_status FROM adv WHERE old_status <> new_status",
)
def rule_transitions(spark, sf_dir):
    return feedback.transitions(_advanced(spark, sf_dir))


_PROFILES = """wk AS (SELECT store_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, noise_pred,
  count(*) AS n FROM v_tel WHERE noise_pred IS NOT NULL GROUP BY ALL),
prof AS (SELECT store_id, week, CAST(sum(n) AS BIGINT) AS n_total,
  (list(noise_pred ORDER BY n DESC, noise_pred DESC))[1] AS dominant,
  CAST(max(n) AS DOUBLE) / sum(n) AS share FROM wk GROUP BY ALL)"""


def _profiles(spark, sf_dir):
    return feedback.noise_profiles(view(spark, sf_dir, "v_tel"))


@query(
    "A34",
    q.cte("v_tel", extra=_PROFILES)
    + """SELECT store_id, week, n_total, dominant, round(share, 6) AS dominant_share FROM prof""",
)
def weekly_noise_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir).select(
        "store_id",
        F.date_format("week", "yyyy-MM-dd").alias("week"),
        "n_total",
        "dominant",
        F.round("dominant_share", 6).alias("dominant_share"),
    )


@query(
    "A35",
    q.cte("v_tel", extra=_PROFILES)
    + """SELECT store_id, week, round(share, 6) AS dominant_share FROM (SELECT *, lag(share) OVER (
  PARTITION BY store_id ORDER BY week) AS prev FROM prof) WHERE share >= 1.02 * prev""",
)
def noise_shift_flags(spark, sf_dir):
    """Weeks whose dominant share grew by the given factor against the week before."""
    flags = feedback.noise_shift_flags(_profiles(spark, sf_dir), multiplier=1.02)
    return flags.select(
        "store_id",
        F.date_format("week", "yyyy-MM-dd").alias("week"),
        F.round("dominant_share", 6).alias("dominant_share"),
    )


@query(
    "A43",
    q.cte("v_utt")
    + """SELECT round(sum(duration_s) / 3600, 6) AS pool_hours, sum(duration_s) / 3600 >= 5
  AS triggered FROM v_utt""",
)
def retrain_trigger(spark, sf_dir):
    return feedback.retrain_trigger(view(spark, sf_dir, "v_utt")).select(
        F.round("pool_hours", 6).alias("pool_hours"), "triggered"
    )


@query(
    "A44",
    q.cte("v_verdict")
    + """, gold AS (SELECT doc_id AS transcription_id, CASE WHEN quality = 1 THEN 'correct'
  ELSE 'wrong' END AS gold FROM labels), j AS (SELECT verdict = gold AS same FROM v_verdict
  JOIN gold USING (transcription_id))
SELECT count(*) AS n, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS agreement,
  count(*) >= 100 AND avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) >= 0.9 AS calibrated FROM j""",
)
def judge_agreement(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("transcription_id"),
        F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("verdict"),
    )
    out = feedback.judge_agreement(view(spark, sf_dir, "v_verdict"), gold)
    return out.select("n", F.round("agreement", 6).alias("agreement"), "calibrated")


_QUEUE = """queue AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'pending' ELSE 'accepted' END
  AS status FROM labels)"""


def _queue(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("transcription_id"),
        F.lit("review").alias("reason"),
        F.when(F.col("quality") == 0, "pending").otherwise("accepted").alias("status"),
        F.lit(None).cast("string").alias("reviewer_note"),
        F.lit(None).cast("string").alias("resolved_at"),
    )


@query("W16", f"WITH {_QUEUE} SELECT id FROM queue WHERE status = 'pending'")
def pending_reviews(spark, sf_dir):
    return feedback.pending_reviews(_queue(spark, sf_dir)).select("id")


@query(
    "W16 S9",
    f"""WITH {_QUEUE}, res AS (SELECT o_custkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'rejected'
  ELSE 'accepted' END AS status, 'order ' || CAST(o_orderkey AS VARCHAR) AS note,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT q.id, coalesce(r.status, q.status) AS status, r.note AS reviewer_note FROM queue q
  LEFT JOIN res r ON r.id = q.id AND r.rn = 1""",
)
def resolved_reviews(spark, sf_dir):
    resolutions = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("accepted").alias("status"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("reviewer_note"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("resolved_at"),
    )
    out = feedback.resolve_reviews(_queue(spark, sf_dir), resolutions)
    return out.select("id", "status", "reviewer_note")


# The chain: utterances are transcribed, doubtful ones harvested and judged; what is judged feeds the
# miner, the training pool and the shadow run of a candidate that hears the mined pairs right.
_CHAIN = f"""{_SUBS},
heard AS (SELECT p.utterance_id, p.lang, p.ref, p.hyp, CAST(split_part(p.utterance_id, '-', 1) AS BIGINT) AS doc,
  CAST(split_part(p.utterance_id, '-', 2) AS BIGINT) AS seg, guard_fired FROM v_pair p),
reasons AS (SELECT utterance_id, utterance_id AS transcription_id, concat_ws(',',
  CASE WHEN (doc * 7 + seg) % 30 > 6 THEN 'low_logprob' END, CASE WHEN guard_fired THEN 'guard_flags' END) AS reasons
  FROM heard),
{_HARVEST},
judged AS (SELECT h.*, CASE (doc + seg) % 3 WHEN 0 THEN CASE WHEN doc % 4 <> 0 THEN 'training' ELSE 'review' END
    WHEN 1 THEN CASE WHEN doc % 5 > 0 THEN 'training+miner' ELSE 'review' END ELSE 'review' END AS route
  FROM heard h JOIN work w ON w.transcription_id = h.utterance_id),
picked AS (SELECT s.* FROM subs s JOIN judged USING (utterance_id) WHERE route = 'training+miner'),
{_mined_sql('picked')},
said AS (SELECT j.*, {q.words('ref_n')} AS rw, {q.words('hyp_n')} AS hw FROM judged j JOIN (
  SELECT utterance_id, ref_n, hyp_n FROM n) USING (utterance_id)),
scored AS (SELECT *, levenshtein({q.words_to_symbols('rw', 'vocab')}, {q.words_to_symbols('hw', 'vocab')}) AS edits
  FROM (SELECT *, list_distinct(list_concat(rw, hw)) AS vocab FROM said WHERE len(rw) > 0)),
shadow AS (SELECT CAST(sum(edits) AS DOUBLE) / sum(len(rw)) AS prod_wer,
  CAST(sum(CASE WHEN route = 'training+miner' THEN 0 ELSE edits END) AS DOUBLE) / sum(len(rw)) AS cand_wer FROM scored)"""


@query(
    "A45 F6",
    q.cte("v_tel", extra=f"{_PROFILES}, {_CHAIN}", recursive=True)
    + """SELECT 'cycle-1' AS cycle_id, (SELECT count(*) FROM work) AS n_harvested,
  (SELECT count(*) FROM judged WHERE route = 'training') AS n_training,
  (SELECT count(*) FROM judged WHERE route = 'training+miner') AS n_miner,
  (SELECT count(*) FROM judged WHERE route = 'review') AS n_review,
  (SELECT count(*) FROM mined) AS n_candidates,
  (SELECT count(*) FROM (SELECT share, lag(share) OVER (PARTITION BY store_id ORDER BY week) AS p
    FROM prof) WHERE share >= 2 * p) AS n_noise_flags,
  (SELECT round(sum(len(string_split(ref, ' '))) * 0.4 / 3600, 6) FROM judged WHERE route <> 'review') AS pool_hours,
  (SELECT sum(len(string_split(ref, ' '))) * 0.4 / 3600 >= 5 FROM judged WHERE route <> 'review') AS retrain,
  (SELECT cand_wer <= prod_wer FROM shadow) AS promote""",
)
def cycle_summary(spark, sf_dir):
    """The weekly cycle: each step reads the table of the step before and is stored by its inputs."""
    stages = feedback.CycleStages(spark, work_folder(spark, "cycles"), "cycle-1")
    return _cycle(stages, _transcribed(spark, sf_dir), view(spark, sf_dir, "v_tel"), _menu_words(spark, sf_dir))


def _transcribed(spark, sf_dir):
    doc, seg = [F.split_part("utterance_id", F.lit("-"), F.lit(i)).cast("long") for i in (1, 2)]
    flags = F.when(F.col("guard_fired"), F.array(F.lit("vad_dropped"))).otherwise(F.array().cast("array<string>"))
    return pairs(spark, sf_dir).drop("keywords").select(
        "utterance_id", F.col("utterance_id").alias("transcription_id"), "lang", "ref", "hyp", doc.alias("doc"),
        seg.alias("seg"), flags.alias("guard_flags"), (-((doc * 7 + seg) % 30) / 10.0).alias("avg_logprob"),
        F.lit(0).alias("n_rules"), F.lit(None).cast("string").alias("verdict"),
    )


def _judged(work, heard):
    """A scripted judge over the harvested transcriptions, and where each of them goes."""
    n = (F.col("doc") + F.col("seg")) % 3
    asked = heard.drop("verdict").join(work.select("transcription_id"), "transcription_id")
    verdict = F.when(n == 0, "correct").when(n == 1, "minor_errors").otherwise("wrong")
    reference = F.when((n == 1) & (F.col("doc") % 5 > 0), F.col("ref"))
    route = feedback.route(verdict, reference, F.col("doc") % 4 != 0, F.lit(0.9))
    return asked.select("utterance_id", "lang", "hyp", "ref", "avg_logprob", verdict.alias("verdict"), route.alias("route"))


def _cycle(stages, heard, telemetry, menu):
    heard = stages.run("transcribe", lambda: heard, heard)
    work = stages.run("harvest", lambda: feedback.harvest(heard, cap=None), heard)
    judged = stages.run("judge", lambda: _judged(work, heard), work, heard)
    routes = stages.run("route", lambda: feedback.route_counts(judged), judged)
    confused = stages.run("align", lambda: mining.substitutions(judged.filter("route = 'training+miner'")), judged)
    mined = stages.run("mine", lambda: mining.candidates(confused, menu), confused, menu)
    profiles = stages.run("profile", lambda: feedback.noise_profiles(telemetry).drop("counts"), telemetry)
    flags = stages.run("noise", lambda: feedback.noise_shift_flags(profiles), profiles)
    kept = judged.filter("route <> 'review'").select(
        (F.size(F.split("ref", " ")) * 0.4).alias("duration_s")
    )
    retrain = stages.run("retrain", lambda: feedback.retrain_trigger(kept), judged)
    shadow = judged.select(
        "lang", "ref", F.col("hyp").alias("prod_hyp"),
        F.when(F.col("route") == "training+miner", F.col("ref")).otherwise(F.col("hyp")).alias("cand_hyp"),
        F.col("avg_logprob").alias("prod_logprob"), F.col("avg_logprob").alias("cand_logprob"),
    )
    measured = stages.run("shadow", lambda: metrics.paired_model_metrics(shadow), judged)
    decision = stages.run("promote", lambda: gates.shadow_gate(measured).select("promote"), measured)
    out = feedback.cycle_summary("cycle-1", work, routes, mined, flags, retrain, decision)
    return out.withColumn("pool_hours", F.round("pool_hours", 6))


@query(
    "F3",
    f"""WITH {q.SEG} SELECT utterance_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS score
  FROM v_seg""",
)
def batch_scoring(spark, sf_dir):
    """User code over batches: the scorer is built once per partition."""
    from soundquay.functions.hooks import score_with

    def make_scorer():
        def score(batch):
            return batch.assign(score=batch["text"].str.split().str.len()).drop(columns="text")

        return score

    return score_with(
        utterances(spark, sf_dir), make_scorer, "utterance_id string, score long", ["utterance_id", "text"]
    )
