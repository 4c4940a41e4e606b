"""Short signals: levels, mixing, clips, windows, logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.functions import signal as s
from soundquay.operators.order import number_rows
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.views import view

RATE = 16  # samples per second of the short test signals
BED = 150  # samples of a bed: more than a voice has, so that the voice repeats

_D = "list_transform(x, lambda v: v::DOUBLE)"


def _rms(x: str) -> str:
    return (
        f"CASE WHEN len({x}) = 0 THEN 0.0 ELSE sqrt(list_sum(list_transform({x}, "
        f"lambda v: v::DOUBLE * v::DOUBLE)) / len({x})) END"
    )


def _fingerprint(name: str):
    """A signal as two numbers that depend on every sample and its place."""
    x = F.col(name)
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    placed = F.aggregate(
        F.transform(x, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return [
        F.size(x).cast("long").alias("n"),
        F.round(total, 4).alias("total"),
        F.round(placed, 3).alias("placed"),
    ]


def _fingerprint_sql(x: str) -> str:
    return (
        f"CAST(len({x}) AS BIGINT) AS n, "
        f"round(coalesce(list_sum(list_transform({x}, lambda v: v::DOUBLE)), 0), 4) AS total, "
        f"round(coalesce(list_sum(list_transform({x}, lambda v, i: v::DOUBLE * i)), 0), 3) AS placed"
    )


@query("G1", q.cte("v_sig") + f"SELECT vec_id, round({_rms('x')}, 6) AS rms FROM v_sig")
def signal_levels(spark, sf_dir):
    sig = view(spark, sf_dir, "v_sig")
    return sig.select("vec_id", F.round(s.rms(F.col("x")), 6).alias("rms"))


_ACTIVE = """act AS (SELECT vec_id, list_filter(x, lambda v, i: (i - 1 >= 8 AND i - 1 < 20)
  OR (i - 1 >= 16 AND i - 1 < 16 + vec_id % 30)) AS x FROM v_sig)"""


@query("G2", q.cte("v_sig", extra=_ACTIVE) + f"SELECT vec_id, round({_rms('x')}, 6) AS rms FROM act")
def speech_levels(spark, sf_dir):
    """Level inside the union of two overlapping intervals."""
    intervals = F.array(
        F.struct(F.lit(0.5).alias("start"), F.lit(1.25).alias("end")),
        F.struct(
            F.lit(1.0).alias("start"), (1.0 + (F.col("vec_id") % 30) / RATE).alias("end")
        ),
    )
    sig = view(spark, sf_dir, "v_sig")
    return sig.select(
        "vec_id", F.round(s.speech_rms(F.col("x"), intervals, RATE), 6).alias("rms")
    )


# each signal is mixed with the next one; every ninth noise is silent, every fifth is loud
_MIX = f"""side AS (SELECT vec_id, list_transform(x, lambda v: v::DOUBLE * CASE WHEN vec_id % 5 = 0
  THEN 6 ELSE 1 END) AS x, vec_id + 1 AS next_id FROM v_sig),
noise AS (SELECT vec_id, list_transform(x, lambda v: CASE WHEN vec_id % 9 = 0 THEN 0.0
  ELSE v::DOUBLE END) AS y FROM v_sig),
lev AS (SELECT s.vec_id, s.x, n.y, {_rms('s.x')} AS sr, {_rms('n.y')} AS nr,
  CASE s.vec_id % 3 WHEN 0 THEN 10.0 WHEN 1 THEN 0.0 ELSE -5.0 END::DOUBLE AS snr
  FROM side s JOIN noise n ON n.vec_id = s.next_id),
g AS (SELECT *, CASE WHEN nr < 1e-9 OR sr < 1e-9 THEN 0.0 ELSE sr / (nr * pow(10.0, snr / 20)) END
  AS gain FROM lev),
m AS (SELECT *, list_transform(list_zip(x, y), lambda p: p[1] + gain * p[2]) AS raw FROM g),
pk AS (SELECT *, list_max(list_transform(raw, lambda v: abs(v))) AS peak FROM m),
mixed AS (SELECT *, CASE WHEN gain = 0 THEN x WHEN peak > 0.99 THEN
  list_transform(raw, lambda v: v * 0.99 / peak) ELSE raw END AS z FROM pk)"""


def _mixes(spark, sf_dir):
    sig = view(spark, sf_dir, "v_sig").select("vec_id", "x")
    loud = F.when(F.col("vec_id") % 5 == 0, 6.0).otherwise(1.0)
    clean = sig.select(
        "vec_id", s.scale(F.col("x"), loud).alias("x"), (F.col("vec_id") + 1).alias("next_id")
    )
    noise = sig.select(
        F.col("vec_id").alias("next_id"),
        s.scale(F.col("x"), F.when(F.col("vec_id") % 9 == 0, 0.0).otherwise(1.0)).alias("y"),
    )
    snr = (
        F.when(F.col("vec_id") % 3 == 0, 10.0).when(F.col("vec_id") % 3 == 1, 0.0).otherwise(-5.0)
    )
    return (
        clean.join(noise, "next_id")
        .withColumn("snr", snr)
        .withColumn("level", s.rms(F.col("x")))
        .withColumn("gain", s.mix_gain(F.col("y"), F.col("level"), F.col("snr")))
    )


@query(
    "G3",
    q.cte("v_sig", extra=_MIX)
    + f"SELECT vec_id, round(gain, 5) AS gain, {_fingerprint_sql('z')} FROM mixed",
)
def noise_mixes(spark, sf_dir):
    mixed = _mixes(spark, sf_dir).withColumn("z", s.mix(F.col("x"), F.col("y"), F.col("gain")))
    return mixed.select("vec_id", F.round("gain", 5).alias("gain"), *_fingerprint("z"))


@query(
    "G4",
    q.cte("v_sig", extra=_MIX)
    + """SELECT vec_id, snr, CASE WHEN gain = 0 THEN NULL ELSE round(20 * log10(sr / (gain * nr)), 4)
  END AS achieved, gain = 0 AS silent FROM g""",
)
def achieved_snr(spark, sf_dir):
    achieved = s.achieved_snr_db(F.col("y"), F.col("level"), F.col("gain"))
    silent = achieved == float("inf")
    return _mixes(spark, sf_dir).select(
        "vec_id",
        "snr",
        F.when(~silent, F.round(achieved, 4)).alias("achieved"),
        silent.alias("silent"),
    )


@query(
    "G5",
    q.cte("v_sig")
    + f"""SELECT vec_id, {_fingerprint_sql('w')} FROM (SELECT vec_id, list_slice(x,
  (vec_id * 31) % (len(x) - 20 + 1) + 1, (vec_id * 31) % (len(x) - 20 + 1) + 20) AS w FROM v_sig)""",
)
def noise_windows(spark, sf_dir):
    sig = view(spark, sf_dir, "v_sig").withColumn(
        "w", s.noise_window(F.col("x"), F.lit(20), (F.col("vec_id") * 31).cast("int"))
    )
    return sig.select("vec_id", *_fingerprint("w"))


# the loop in closed form: sample t belongs to copies k with k*step <= t < k*step + n
_LOOP = """base AS (SELECT vec_id, list_transform(x, lambda v: v::DOUBLE) AS x, len(x) AS n, 8 AS lap,
  len(x) - 8 AS step, 150 AS want FROM v_sig),
t AS (SELECT vec_id, x, n, lap, step, want, unnest(range(0, want)) AS t FROM base),
k AS (SELECT *, unnest([t // step, t // step - 1]) AS k FROM t),
p AS (SELECT *, t - k * step AS i, CAST(ceil((want - n) * 1.0 / step) AS BIGINT) AS last FROM k
  WHERE k >= 0 AND t - k * step < n),
w AS (SELECT vec_id, t, x[i + 1] * CASE WHEN i < lap AND k > 0 THEN pow(sin(i * pi() / 2 / (lap - 1)), 2)
  ELSE 1 END * CASE WHEN i >= n - lap AND k < last THEN pow(sin((n - 1 - i) * pi() / 2 / (lap - 1)), 2)
  ELSE 1 END AS v FROM p WHERE k <= last),
s AS (SELECT vec_id, t, sum(v) AS v FROM w GROUP BY ALL)"""


@query(
    "G6",
    q.cte("v_sig", extra=_LOOP)
    + """SELECT vec_id, count(*) AS n, round(sum(v), 4) AS total, round(sum(v * (t + 1)), 3) AS placed
  FROM s GROUP BY vec_id""",
)
def looped_noise(spark, sf_dir):
    """Signals looped to a longer length with a crossfade at each seam."""
    sig = view(spark, sf_dir, "v_sig").select(
        "vec_id", F.lit(150).alias("want"), F.col("x").cast("array<double>").alias("x")
    )
    return s.loop_to_length(sig, "x", "want", overlap=8).select("vec_id", *_fingerprint("x"))


@query(
    "G7",
    q.cte("v_sig")
    + f"""SELECT vec_id, CAST(i AS BIGINT) AS clip_start, {_fingerprint_sql('c')} FROM (SELECT vec_id, i,
  list_slice(x, i + 1, i + 24) AS c FROM (SELECT vec_id, x, unnest(range(0, len(x) - 10 + 1, 16)) AS i
  FROM v_sig))""",
)
def cut_clips(spark, sf_dir):
    clips = s.cut_clips(view(spark, sf_dir, "v_sig"), "x", clip_len=24, hop=16, min_len=10)
    return clips.select("vec_id", F.col("clip_start").cast("long").alias("clip_start"), *_fingerprint("clip"))


@query(
    "G8",
    q.cte("v_sig")
    + f"""SELECT vec_id, {_fingerprint_sql('x')} FROM v_sig""",
)
def rejoined_recordings(spark, sf_dir):
    """Slices of a recording put together again in start order.

    Gathering by recording is what the operator is; a recording is one row in the data model.
    """
    clips = s.cut_clips(view(spark, sf_dir, "v_sig"), "x", clip_len=16, hop=16, min_len=1)
    joined = clips.groupBy("vec_id").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("clip_start", "clip"))), lambda c: c["clip"]
            )
        ).alias("x")
    )
    return joined.select("vec_id", *_fingerprint("x"))


_OVER = f"""bed AS (SELECT vec_id, split, list_transform(range(0, {BED}), lambda i: x[i % len(x) + 1]::DOUBLE * 9) AS b, row_number()
  OVER (PARTITION BY split ORDER BY vec_id) - 1 AS pos FROM v_sig WHERE label < 5),
voice AS (SELECT vec_id, split, list_transform(x, lambda v: v::DOUBLE) AS x, row_number()
  OVER (PARTITION BY split ORDER BY vec_id) - 1 AS idx, count(*) OVER (PARTITION BY split) AS n
  FROM v_sig WHERE label >= 5),
pr AS (SELECT b.vec_id, b.b, list_transform(range(0, len(b.b)), lambda i: v.x[i % len(v.x) + 1]) AS y
  FROM bed b JOIN voice v ON v.split = b.split AND v.idx = b.pos % v.n),
gg AS (SELECT *, {_rms('b')} * pow(10.0, -3.0 / 20) / {_rms('y')} AS gain FROM pr),
raw AS (SELECT vec_id, list_transform(list_zip(b, y), lambda p: p[1] + gain * p[2]) AS r FROM gg),
top AS (SELECT *, list_max(list_transform(r, lambda v: abs(v))) AS peak FROM raw),
o AS (SELECT vec_id, CASE WHEN peak > 0.9 THEN list_transform(r, lambda v: v * 0.9 / peak) ELSE r END
  AS z FROM top)"""


@query("G9 J5", q.cte("v_sig", extra=_OVER) + f"SELECT vec_id, {_fingerprint_sql('z')} FROM o")
def voice_over_bed(spark, sf_dir):
    """Voices dealt in turn over engine beds of the same split."""
    sig = view(spark, sf_dir, "v_sig")
    beds = number_rows(
        sig.filter("label < 5").select("vec_id", "split", s.scale(s.tile(F.col("x"), F.lit(BED)), F.lit(9.0)).alias("bed")),
        ["vec_id"],
        ["split"],
        "pos",
    )
    spoken = sig.filter("label >= 5").select(
        "vec_id", "split", s.scale(F.col("x"), F.lit(1.0)).alias("voice")
    )
    voices = number_rows(spoken, ["vec_id"], ["split"], "idx").drop("vec_id")
    sizes = spoken.groupBy("split").agg(F.count(F.lit(1)).alias("n_voices"))
    dealt = beds.join(sizes, "split").withColumn("idx", F.pmod("pos", "n_voices"))
    laid = dealt.join(voices, ["split", "idx"]).withColumn(
        "z", s.overlay(F.col("bed"), F.col("voice"), -3.0)
    )
    return laid.select("vec_id", *_fingerprint("z"))


@query(
    "G10",
    q.cte("v_sig")
    + f"""SELECT vec_id, {_fingerprint_sql('z')} FROM (SELECT vec_id, list_transform(range(0,
  50 + vec_id % 30), lambda i: coalesce(x[i + 1]::DOUBLE, 0.0)) AS z FROM v_sig)""",
)
def fitted_lengths(spark, sf_dir):
    sig = view(spark, sf_dir, "v_sig").withColumn(
        "z", s.fit_length(F.col("x"), (50 + F.col("vec_id") % 30).cast("int"))
    )
    return sig.select("vec_id", *_fingerprint("z"))


@query(
    "G11",
    q.cte("v_sig")
    + f"""SELECT vec_id, CAST(i AS BIGINT) AS clip_start, {_fingerprint_sql('c')} FROM (SELECT vec_id, i,
  list_slice(z, i + 1, i + w) AS c FROM (SELECT vec_id, z, w, unnest(range(0, len(z) - w + 1, 8)) AS i
  FROM (SELECT vec_id, w, list_transform(range(0, greatest(w, len(x))), lambda i:
    coalesce(x[i + 1]::DOUBLE, 0.0)) AS z FROM (SELECT vec_id, x, CASE WHEN vec_id % 5 = 0 THEN 80
      ELSE 16 END AS w FROM v_sig))))""",
)
def classifier_windows(spark, sf_dir):
    """Overlapping full windows; signals shorter than their window, one in five here, are padded."""
    sig = view(spark, sf_dir, "v_sig")
    width = F.when(F.col("vec_id") % 5 == 0, 5 * RATE).otherwise(RATE)
    windows = s.full_windows(sig.select("vec_id", "x"), "x", width, RATE // 2)
    return windows.select(
        "vec_id", F.col("clip_start").cast("long").alias("clip_start"), *_fingerprint("clip")
    )


_CLASSES = [*fixed.BANK_SUBTYPES, fixed.CLEAN]
_LOGITS = f"""w AS (SELECT vec_id, unnest(range(0, 8)) AS k, x FROM v_sig),
ml AS (SELECT vec_id, i, avg(x[k * 8 + i]::DOUBLE * 12) AS z FROM (SELECT *, unnest(range(1, 9)) AS i
  FROM w) GROUP BY ALL),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM ml),
p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (
  PARTITION BY vec_id ORDER BY z DESC, i) AS rn FROM e)"""


@query(
    "G12",
    q.cte("v_sig", extra=_LOGITS)
    + """SELECT vec_id, CASE WHEN i < 8 AND p >= 0.3 THEN (['AA','AB','AC','BA','BB','BC','CA','CLEAN'])[i]
  END AS subtype, round(p, 6) AS confidence FROM p WHERE rn = 1""",
)
def gated_predictions(spark, sf_dir):
    """Mean logits over eight windows, softmax, arg-max with the confidence gate."""
    windows = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda k: F.transform(F.slice("x", k * 8 + 1, 8), lambda v: v.cast("double") * 12),
    )
    sig = view(spark, sf_dir, "v_sig").select("vec_id", s.mean_vector(windows).alias("logits"))
    subtype, confidence = s.decide(F.col("logits"), _CLASSES, 0.3)
    return sig.select(
        "vec_id", subtype.alias("subtype"), F.round(confidence, 6).alias("confidence")
    )


_EXAMPLES = f"""clip AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY
  md5('{fixed.SEED}|' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM v_sig WHERE subtype <> 'CLEAN'),
capped AS (SELECT * FROM clip WHERE rn <= 30),
pool AS (SELECT vec_id AS clean_vec, list_transform(x, lambda v: v::DOUBLE) AS c, row_number() OVER (
  ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM v_sig WHERE subtype = 'CLEAN'),
dealt AS (SELECT k.vec_id, k.subtype, k.recording_id, p.c, list_transform(k.x, lambda v: v::DOUBLE) AS y,
  CASE {q.unit('CAST(k.vec_id AS VARCHAR)', "'level'", seed=fixed.SEED)} % 3 WHEN 0 THEN 10.0
   WHEN 1 THEN 0.0 ELSE -5.0 END::DOUBLE AS snr FROM capped k JOIN pool p
  ON p.idx = {q.unit('CAST(k.vec_id AS VARCHAR)', "'clean'", seed=fixed.SEED)} % p.n),
gm AS (SELECT *, {_rms('c')} / ({_rms('y')} * pow(10.0, snr / 20)) AS gain FROM dealt),
rawm AS (SELECT *, list_transform(list_zip(c, y), lambda p: p[1] + gain * p[2]) AS r FROM gm),
pkm AS (SELECT *, list_max(list_transform(r, lambda v: abs(v))) AS peak FROM rawm),
ex AS (SELECT vec_id, subtype AS label, recording_id AS grp, 'raw' AS kind,
    list_transform(x, lambda v: v::DOUBLE) AS z FROM capped
  UNION ALL SELECT vec_id, subtype, recording_id, 'mixed', CASE WHEN peak > 0.99 THEN
    list_transform(r, lambda v: v * 0.99 / peak) ELSE r END FROM pkm
  UNION ALL SELECT clean_vec, 'CLEAN', 'clean', 'clean', c FROM pool)"""


@query(
    "G13 W8",
    q.cte("v_sig", extra=_EXAMPLES)
    + f"SELECT vec_id, label, grp, kind, {_fingerprint_sql('z')} FROM ex",
)
def labelled_examples(spark, sf_dir):
    """Raw clips, one mix per clip with a clean signal, and the clean signals themselves."""
    from soundquay.operators.examples import labelled_examples as build

    sig = view(spark, sf_dir, "v_sig").select("vec_id", "subtype", "recording_id", "x")
    return build(sig, key="vec_id", per_subtype=30).select(
        "vec_id", "label", "grp", "kind", *_fingerprint("z")
    )
