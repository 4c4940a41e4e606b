"""Corpus building: numbering, splits, grids, samples, training draws, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions.text import tokens, uniform_hash
from soundquay.operators import corpus
from soundquay.operators.order import number_rows
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.views import pairs, table, utterances, view
from soundquay.sources.constants import constant_table

_SEED = fixed.SEED


@query(
    "W1",
    q.cte("v_utt")
    + """SELECT doc_id, 'cl-' || lang || '-' || printf('%05d', row_number() OVER (PARTITION BY lang
  ORDER BY source, path) - 1) AS utterance_id FROM v_utt""",
)
def renumbered_manifest(spark, sf_dir):
    return corpus.renumber(view(spark, sf_dir, "v_utt").drop("utterance_id")).select(
        "doc_id", "utterance_id"
    )


@query(
    "W2",
    q.cte("v_bank")
    + """SELECT vec_id, 'nz-' || subtype || '-' || printf('%04d', row_number() OVER (
  PARTITION BY subtype ORDER BY recording_id, vec_id) - 1) AS clip_id
  FROM v_bank""",
)
def numbered_clips(spark, sf_dir):
    bank = view(spark, sf_dir, "v_bank").drop("clip_id")
    return corpus.number_clips(bank, ["recording_id", "vec_id"]).select("vec_id", "clip_id")


@query(
    "W3",
    q.cte("v_utt")
    + """, r AS (SELECT utterance_id, lang, sum(duration_s) OVER (PARTITION BY lang
  ORDER BY source, path) - duration_s AS before, sum(duration_s) OVER (PARTITION BY lang) / 3
  AS dummy FROM v_utt) SELECT utterance_id FROM r WHERE before < 5000""",
)
def hours_limit(spark, sf_dir):
    """Take utterances in order until the wanted length is reached, crossing row included."""
    rows = view(spark, sf_dir, "v_utt").select("utterance_id", "lang", "source", "path", "duration_s")
    return corpus.take_until(rows, ["source", "path"], "duration_s", 5000.0, ["lang"]).select(
        "utterance_id"
    )


_SPEAKERS = f"""spk AS (SELECT accent, speaker, count(*) AS n_rows,
  md5('{_SEED}|' || speaker) AS o FROM v_utt GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY accent ORDER BY o, speaker) AS rn,
  count(*) OVER (PARTITION BY accent) AS n FROM spk),
held AS (SELECT accent, speaker, n_rows, 'stratum' AS reason FROM ranked
  WHERE rn <= greatest(1, round_even(n * 0.21, 0))),
rest AS (SELECT *, sum(n_rows) OVER (ORDER BY o, accent, speaker) - n_rows AS before FROM ranked
  WHERE rn > greatest(1, round_even(n * 0.21, 0))),
top_up AS (SELECT accent, speaker, n_rows, 'top_up' AS reason FROM rest
  WHERE before + (SELECT sum(n_rows) FROM held) < (SELECT count(*) * 0.4 FROM v_utt))"""


@query(
    "W4 W5",
    q.cte("v_utt", extra=_SPEAKERS) + "SELECT * FROM held UNION ALL SELECT * FROM top_up",
)
def held_out_speakers(spark, sf_dir):
    utts = view(spark, sf_dir, "v_utt")
    wanted = int(-(-utts.count() * 2 // 5))  # two fifths of all utterances, rounded up
    return corpus.hold_out_speakers(utts, 0.21, _SEED, wanted)


@query(
    "W6",
    q.cte("v_bank")
    + f"""SELECT subtype, recording_id, CASE WHEN row_number() OVER (PARTITION BY subtype
  ORDER BY md5('{_SEED}|' || recording_id), recording_id) <= greatest(1, round_even(
    count(*) OVER (PARTITION BY subtype) * 0.3, 0)) THEN 'eval' ELSE 'train' END AS split
  FROM (SELECT DISTINCT subtype, recording_id FROM v_bank)""",
)
def recording_split(spark, sf_dir):
    return corpus.split_recordings(view(spark, sf_dir, "v_bank"), 0.3, _SEED)


@query(
    "W7",
    q.cte("v_sig")
    + """, cut AS (SELECT vec_id, x, CAST(floor(len(x) * 0.7) AS BIGINT) AS at_ FROM v_sig)
SELECT vec_id, 'train' AS split, at_ AS n, round(list_sum(list_transform(x[1:at_],
  lambda v: v::DOUBLE)), 5) AS total FROM cut
UNION ALL SELECT vec_id, 'eval', len(x) - at_, round(list_sum(list_transform(x[at_ + 1:],
  lambda v: v::DOUBLE)), 5) FROM cut""",
)
def time_block_split(spark, sf_dir):
    parts = corpus.split_stream(view(spark, sf_dir, "v_sig").select("vec_id", "x"), "x", 0.3)
    total = F.aggregate("part", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return parts.select(
        "vec_id", "split", F.size("part").cast("long").alias("n"), F.round(total, 5).alias("total")
    )


@query(
    "W8",
    q.cte("v_rec")
    + f"""SELECT lang, noise_subtype, noise_level, uid FROM (SELECT *, row_number() OVER (
  PARTITION BY lang, noise_subtype, noise_level ORDER BY md5('{_SEED}|' || uid), uid) AS rn
  FROM (SELECT DISTINCT lang, noise_subtype, noise_level, CAST(l_orderkey AS VARCHAR) || '-' ||
    CAST(l_linenumber AS VARCHAR) AS uid FROM v_rec)) WHERE rn <= 6""",
)
def cell_samples(spark, sf_dir):
    rec = view(spark, sf_dir, "v_rec").select(
        "lang",
        "noise_subtype",
        "noise_level",
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uid"),
    )
    return corpus.sample_distinct(rec, ["lang", "noise_subtype", "noise_level"], "uid", 6)


_BANK_KNOWN = "bank AS (SELECT * FROM v_bank WHERE subtype <> 'ZZ' AND split = 'eval')"


def _eval_clips(spark, sf_dir):
    bank = view(spark, sf_dir, "v_bank")
    return bank.filter((F.col("subtype") != "ZZ") & (F.col("split") == "eval"))


@query(
    "J4 J5 P22",
    q.cte("v_utt", "v_bank", extra=_BANK_KNOWN)
    + f""", clean AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY utterance_id) - 1 AS pos
  FROM v_utt), lv AS (SELECT * FROM (VALUES (0, '05', 10.0), (1, '10', 0.0), (2, '15', -5.0))
  t(lp, level, snr)),
clips AS (SELECT subtype, clip_id, row_number() OVER (PARTITION BY subtype ORDER BY clip_id) - 1
  AS idx, count(*) OVER (PARTITION BY subtype) AS n FROM bank),
grid AS (SELECT c.utterance_id, s.subtype, l.level, l.snr, (c.pos * 3 + l.lp) % s.n AS idx
  FROM clean c, (SELECT DISTINCT subtype, n FROM clips) s, lv l)
SELECT g.utterance_id || '__noise-' || g.subtype || '-' || g.level AS utterance_id, k.clip_id
  AS noise_clip_id, CAST(g.snr AS DOUBLE) AS snr_db_target,
  CAST('0x' || substr(sha256('{_SEED}|' || g.utterance_id || '|' || k.clip_id || '|' || g.level),
    1, 8) AS BIGINT) AS mix_seed
  FROM grid g JOIN clips k ON k.subtype = g.subtype AND k.idx = g.idx""",
)
def noise_grid(spark, sf_dir):
    clean = view(spark, sf_dir, "v_utt").select("utterance_id", "lang", "text")
    grid = corpus.noise_grid(clean, _eval_clips(spark, sf_dir), corpus.levels_table(spark))
    return grid.select("utterance_id", "noise_clip_id", "snr_db_target", "mix_seed")


@query(
    "W12 J5",
    q.cte("v_utt", "v_bank", extra=_BANK_KNOWN)
    + f""", pool AS (SELECT lang, utterance_id, row_number() OVER (PARTITION BY lang
  ORDER BY utterance_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM v_utt),
lv AS (SELECT * FROM (VALUES (0, '05', 8.0, 15.0), (1, '10', -2.0, 2.0), (2, '15', -7.0, -3.0))
  t(lp, level, lo, hi)),
clips AS (SELECT subtype, clip_id, row_number() OVER (PARTITION BY subtype ORDER BY clip_id) - 1
  AS idx, count(*) OVER (PARTITION BY subtype) AS n FROM bank),
cells AS (SELECT p.lang, p.n AS pn, s.subtype, s.n AS cn, l.*, slot FROM
  (SELECT DISTINCT lang, n FROM pool) p, (SELECT DISTINCT subtype, n FROM clips) s, lv l,
  (SELECT unnest(range(0, 40)) AS slot))
SELECT 'en-' || c.lang || '-' || c.subtype || '-' || c.level || '-' ||
    printf('%03d', c.slot) AS utterance_id, p.utterance_id AS clean_id,
  k.clip_id AS noise_clip_id, round(lo + {q.uniform('c.lang', 'c.subtype', 'c.level',
    'CAST(c.slot AS VARCHAR)', seed=_SEED)} * (hi - lo), 2)::DOUBLE AS snr_db_target
  FROM cells c JOIN pool p ON p.lang = c.lang AND p.idx = c.slot % c.pn
  JOIN clips k ON k.subtype = c.subtype AND k.idx = (c.lp * 40 + c.slot) % c.cn""",
)
def frozen_noisy_grid(spark, sf_dir):
    pool = view(spark, sf_dir, "v_utt").select("utterance_id", "lang", "text")
    grid = corpus.eval_noisy_grid(
        pool, _eval_clips(spark, sf_dir), corpus.levels_table(spark), per_cell=40
    )
    return grid.select("utterance_id", "clean_id", "noise_clip_id", "snr_db_target")


@query(
    "J6 U4",
    q.cte("v_utt")
    + """, held AS (SELECT utterance_id FROM v_utt WHERE source IN ('src0', 'src7', 'src11')),
mixed AS (SELECT utterance_id || '__noise-AA-05' AS utterance_id, utterance_id AS clean_id
  FROM v_utt WHERE source IN ('src2', 'src7')),
reserved AS (SELECT utterance_id FROM held UNION SELECT utterance_id FROM mixed
  UNION SELECT clean_id FROM mixed)
SELECT utterance_id FROM v_utt WHERE utterance_id NOT IN (SELECT utterance_id FROM reserved)""",
)
def training_pool(spark, sf_dir):
    utts = view(spark, sf_dir, "v_utt").select("utterance_id", "source", "lang")
    held = utts.filter(F.col("source").isin("src0", "src7", "src11")).withColumn(
        "clean_id", F.lit(None).cast("string")
    )
    mixed = utts.filter(F.col("source").isin("src2", "src7")).select(
        F.concat("utterance_id", F.lit("__noise-AA-05")).alias("utterance_id"),
        F.col("utterance_id").alias("clean_id"),
    )
    return corpus.clean_pool(corpus.reserved_ids(held, mixed), utts).select("utterance_id")


_TARGETS = f"""targets AS (SELECT DISTINCT unnest(string_split({q.norm('text', "'en'")}, ' '))
  AS target FROM benchmark)"""


@query(
    "J8",
    f"""WITH {q.pair_cte()}, {_TARGETS}, kw AS (SELECT utterance_id, unnest(string_split(
  {q.norm('ref', 'lang')}, ' ')) AS word FROM v_pair WHERE lang = 'en')
SELECT DISTINCT utterance_id FROM kw JOIN targets ON word = target AND length(word) >= 7""",
)
def target_utterances(spark, sf_dir):
    """Utterances that carry one of the longer benchmark words as a keyword."""
    targets = table(spark, sf_dir, "benchmark").select(
        F.lit("en").alias("lang"), F.explode(tokens(F.col("text"), F.lit("en"))).alias("target")
    )
    manifest = utterances(spark, sf_dir).filter(F.col("lang") == "en")
    keyed = manifest.select(
        "utterance_id",
        "lang",
        F.filter(tokens(F.col("text"), F.col("lang")), lambda w: F.length(w) >= 7).alias("keywords"),
    )
    return corpus.target_utterances(keyed, targets).select("utterance_id")


_WEIGHTS = """weights AS (SELECT * FROM (VALUES ('es','AA',0.1), ('es','BB',0.6), ('es','CA',0.3),
  ('en','AA',0.25), ('en','BB',0.25), ('en','CA',0.5)) t(lang, noise_subtype, weight))"""


def _weights(spark):
    rows = [("es", "AA", 0.1), ("es", "BB", 0.6), ("es", "CA", 0.3),
            ("en", "AA", 0.25), ("en", "BB", 0.25), ("en", "CA", 0.5)]
    return constant_table(spark, rows, "lang string, noise_subtype string, weight double")


@query(
    "J16",
    q.cte("v_utt", extra=_WEIGHTS)
    + f""", u AS (SELECT utterance_id, lang, {q.uniform('utterance_id', seed=_SEED)} AS u FROM v_utt),
cum AS (SELECT *, sum(weight) OVER (PARTITION BY lang ORDER BY noise_subtype) AS hi FROM weights)
SELECT utterance_id, min(noise_subtype) AS noise_subtype FROM u JOIN cum
  ON cum.lang = u.lang AND u.u < hi GROUP BY utterance_id""",
)
def weighted_subtypes(spark, sf_dir):
    utts = view(spark, sf_dir, "v_utt").select("utterance_id", "lang")
    drawn = utts.withColumn("u", uniform_hash(F.col("utterance_id"), seed=_SEED))
    picked = corpus.weighted_pick(drawn, "u", _weights(spark), "noise_subtype")
    return picked.select("utterance_id", "noise_subtype")


def _u(k: int) -> str:
    return q.uniform("CAST(draw AS VARCHAR)", f"'{k}'", seed=_SEED)


@query(
    "W11 W3 J16",
    q.cte("v_utt", "v_bank", extra=_WEIGHTS)
    + f""", total AS (SELECT count(*) AS n, sum(duration_s) / 2 AS target FROM v_utt),
pool AS (SELECT lang, utterance_id, duration_s, row_number() OVER (PARTITION BY lang
  ORDER BY utterance_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM v_utt),
draws AS (SELECT draw, CASE WHEN {_u(0)} < 0.5 THEN 'es' ELSE 'en' END AS lang,
  {_u(1)} < 0.3 AS is_clean, {_u(2)} AS u2, {_u(3)} AS u3, {_u(4)} AS u4, {_u(5)} AS u5,
  {_u(6)} AS u6 FROM (SELECT unnest(range(0, (SELECT n FROM total) * 4)) AS draw)),
timed AS (SELECT d.*, p.utterance_id, sum(p.duration_s) OVER (ORDER BY d.draw) - p.duration_s
  AS before FROM draws d JOIN pool p ON p.lang = d.lang AND p.idx = CAST(floor(d.u3 * p.n) AS BIGINT)),
kept AS (SELECT * FROM timed WHERE before < (SELECT target FROM total)),
cum AS (SELECT *, sum(weight) OVER (PARTITION BY lang ORDER BY noise_subtype) AS hi FROM weights),
sub AS (SELECT draw, min(noise_subtype) AS st FROM kept JOIN cum
  ON cum.lang = kept.lang AND kept.u2 < hi GROUP BY draw),
clips AS (SELECT subtype, clip_id, row_number() OVER (PARTITION BY subtype ORDER BY clip_id) - 1
  AS idx, count(*) OVER (PARTITION BY subtype) AS n FROM v_bank WHERE split = 'train'),
lv AS (SELECT * FROM (VALUES (0, '05', 8.0, 15.0), (1, '10', -2.0, 2.0), (2, '15', -7.0, -3.0))
  t(lp, level, lo, hi))
SELECT 'tn-' || k.lang || '-' || printf('%06d', k.draw) AS utterance_id,
  k.utterance_id AS clean_id, CASE WHEN is_clean THEN NULL ELSE st END AS noise_subtype,
  CASE WHEN is_clean THEN NULL ELSE level END AS noise_band,
  CASE WHEN is_clean THEN NULL ELSE clip_id END AS noise_clip_id,
  CASE WHEN is_clean THEN NULL ELSE round(lo + u6 * (hi - lo), 2)::DOUBLE END AS snr_db_target
  FROM kept k JOIN sub USING (draw) JOIN lv ON lp = CAST(floor(u4 * 3) AS BIGINT)
  JOIN clips c ON c.subtype = st AND c.idx = CAST(floor(u5 * c.n) AS BIGINT)""",
)
def training_draw(spark, sf_dir):
    """Half of the pool's hours drawn by damage weights, with clean anchors."""
    pool = view(spark, sf_dir, "v_utt").select("utterance_id", "lang", "text", "duration_s")
    size = pool.agg(F.sum("duration_s").alias("s")).first()
    clips = view(spark, sf_dir, "v_bank").filter(F.col("split") == "train")
    drawn = corpus.draw_training(
        pool,
        clips,
        _weights(spark),
        corpus.levels_table(spark),
        target_hours=size["s"] / 2 / 3600.0,
    )
    return drawn.select(
        "utterance_id", "clean_id", "noise_subtype", "noise_band", "noise_clip_id", "snr_db_target"
    )


@query(
    "W13",
    f"""WITH {q.SEG} SELECT utterance_id, CASE (row_number() OVER (ORDER BY utterance_id) - 1) % 3
  WHEN 0 THEN 'voice-a' WHEN 1 THEN 'voice-b' ELSE 'voice-c' END AS voice FROM v_seg""",
)
def rotated_voices(spark, sf_dir):
    utts = utterances(spark, sf_dir).select("utterance_id")
    return corpus.rotate(utts, ["utterance_id"], ["voice-a", "voice-b", "voice-c"], "voice")


@query(
    "W14 U1",
    f"""WITH {q.pair_cte()}, kw AS (SELECT 'rk-' || lang || '-' || utterance_id AS utterance_id,
  lang, 'keyword' AS part, row_number() OVER (PARTITION BY lang ORDER BY utterance_id) AS rn
  FROM v_pair WHERE len(keywords) > 1),
ge AS (SELECT 'rg-' || lang || '-' || utterance_id AS utterance_id, lang, 'generic' AS part,
  row_number() OVER (PARTITION BY lang ORDER BY utterance_id) AS rn FROM v_pair)
SELECT utterance_id, lang, part FROM kw WHERE rn <= 120
UNION ALL SELECT utterance_id, lang, part FROM ge WHERE rn <= 50""",
)
def regression_corpus(spark, sf_dir):
    """The frozen keyword and general parts: the first rows of each language by id."""
    rows = pairs(spark, sf_dir).select("utterance_id", "lang", F.col("ref").alias("text"), "keywords")
    worded = rows.filter(F.size("keywords") > 1)
    return corpus.regression_corpus(worded, rows).select("utterance_id", "lang", "part")


# --- fixed values: sentence templates ---
_TEMPLATES = [
    ("en", 0, "i want {a} and {b}"),
    ("en", 1, "can i get {a} please"),
    ("es", 0, "quiero {a} con {b}"),
    ("es", 1, "me da {a}"),
    ("es", 2, "ponga {a} y {b} por favor"),
]
_TEMPLATE_SQL = "tpl AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{lang}', {no}, '{text}')" for lang, no, text in _TEMPLATES
) + ") t(lang, template_no, template))"


def _choice(key: str, tag: str, n: str) -> str:
    return f"{q.unit(f'CAST({key} AS VARCHAR)', f'{chr(39)}{tag}{chr(39)}', seed=_SEED)} % {n}"


@query(
    "P25",
    f"""WITH {_TEMPLATE_SQL}, names AS (SELECT p_name AS term, row_number() OVER (ORDER BY p_name) - 1
  AS pos FROM (SELECT DISTINCT p_name FROM part)), cnt AS (SELECT count(*) AS n FROM names),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'es' ELSE 'en' END AS lang FROM orders),
c AS (SELECT d.*, {_choice('o_orderkey', 't', "(CASE lang WHEN 'es' THEN 3 ELSE 2 END)")} AS t,
  {_choice('o_orderkey', 'a', '(SELECT n FROM cnt)')} AS a,
  {_choice('o_orderkey', 'b', '(SELECT n FROM cnt)')} AS b FROM d)
SELECT c.o_orderkey, replace(replace(template, '{{a}}', x.term), '{{b}}', y.term) AS text,
  array_to_string(list_sort(list_distinct(CASE WHEN contains(template, '{{b}}')
    THEN [x.term, y.term] ELSE [x.term] END)), ',') AS keywords
  FROM c JOIN tpl ON tpl.lang = c.lang AND tpl.template_no = c.t
  JOIN names x ON x.pos = c.a JOIN names y ON y.pos = c.b""",
)
def order_sentences(spark, sf_dir):
    """One sentence per order from templates and menu items."""
    templates = constant_table(spark, _TEMPLATES, "lang string, template_no long, template string")
    names = number_rows(
        table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct(),
        ["term"],
        (),
        "pos",
    )
    items = names.select(F.explode(F.array(F.lit("es"), F.lit("en"))).alias("lang"), "pos", "term")
    draws = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "es").otherwise("en").alias("lang")
    )
    said = corpus.order_sentences(draws, "o_orderkey", templates, items, items)
    return said.select("o_orderkey", "text", F.array_join("keywords", ",").alias("keywords"))


@query(
    "P25",
    f"""WITH {_TEMPLATE_SQL}, names AS (SELECT DISTINCT 'en' AS lang, p_name AS target FROM part),
c AS (SELECT *, {q.unit('lang', 'target', seed=_SEED)} % 2 AS t FROM names)
SELECT target, replace(template, '{{a}}', target) AS text FROM c JOIN tpl
  ON tpl.lang = c.lang AND tpl.template_no = c.t""",
)
def coverage_sentences(spark, sf_dir):
    """Every menu item is said at least once."""
    templates = constant_table(
        spark,
        [(lang, no, text.replace("{a}", "{w}")) for lang, no, text in _TEMPLATES],
        "lang string, template_no long, template string",
    )
    targets = table(spark, sf_dir, "part").select(
        F.lit("en").alias("lang"), F.col("p_name").alias("target")
    ).distinct()
    return corpus.coverage_sentences(targets, templates).select("target", "text")


@query(
    "P22",
    q.cte("v_utt")
    + f"""SELECT utterance_id || '__noise-BB-10' AS mixed_id, CAST('0x' || substr(sha256(
  '{_SEED}|' || utterance_id || '|' || source || '|10'), 1, 8) AS BIGINT) AS seed FROM v_utt""",
)
def mix_identities(spark, sf_dir):
    utts = view(spark, sf_dir, "v_utt")
    level = F.lit("10")
    return utts.select(
        corpus.mixed_id(F.col("utterance_id"), F.lit("BB"), level).alias("mixed_id"),
        corpus.mix_seed(_SEED, F.col("utterance_id"), F.col("source"), level).alias("seed"),
    )


@query(
    "U1 U2 U3 U4",
    q.cte("v_bank")
    + """, tr AS (SELECT DISTINCT recording_id FROM v_bank WHERE split = 'train'),
ev AS (SELECT DISTINCT recording_id FROM v_bank WHERE split = 'eval')
SELECT 'both' AS part, recording_id FROM (SELECT * FROM tr INTERSECT SELECT * FROM ev)
UNION ALL SELECT 'train_only', recording_id FROM (SELECT * FROM tr EXCEPT SELECT * FROM ev)
UNION ALL SELECT 'any', recording_id FROM (SELECT * FROM tr UNION SELECT * FROM ev)""",
)
def recording_sets(spark, sf_dir):
    bank = view(spark, sf_dir, "v_bank")
    train = bank.filter(F.col("split") == "train").select("recording_id")
    held = bank.filter(F.col("split") == "eval").select("recording_id")

    def part(df, name):
        return df.select(F.lit(name).alias("part"), "recording_id")

    return (
        part(train.intersect(held), "both")
        .unionByName(part(train.subtract(held), "train_only"))
        .unionByName(part(train.union(held).distinct(), "any"))
    )


@query(
    "W9",
    q.cte("v_verdict")
    + f"""SELECT transcription_id FROM (SELECT transcription_id, row_number() OVER (ORDER BY
  md5('{_SEED}|' || CAST(transcription_id AS VARCHAR)), transcription_id) AS rn,
  round_even(count(*) OVER () * 0.02, 0) AS k FROM v_verdict) WHERE rn <= k""",
)
def control_sample(spark, sf_dir):
    rows = view(spark, sf_dir, "v_verdict").select("transcription_id")
    return corpus.control_sample(rows, "transcription_id")
