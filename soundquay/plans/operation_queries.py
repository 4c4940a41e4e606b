"""Operations and streams: drift, alerts, latency, retention, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundquay.operators import operations
from soundquay.plans import sqltext as q
from soundquay.plans.registry import query
from soundquay.plans.views import VIEWS, table, view
from soundquay.sources.stage import work_folder
from soundquay.streaming import jobs

_HALF = "TIMESTAMP '2024-01-16 00:00:00'"

_PSI = f"""x AS (SELECT avg_logprob AS v, CASE WHEN ts < {_HALF} THEN 0 ELSE 1 END AS side FROM v_tel),
lim AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
binned AS (SELECT side, least(9, CAST(floor((v - lo) / (hi - lo) * 10) AS BIGINT)) AS b FROM x, lim),
cnt AS (SELECT g.b, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS c
  FROM (SELECT unnest(range(0, 10)) AS b) g LEFT JOIN binned USING (b) GROUP BY g.b),
sh AS (SELECT greatest(CAST(r AS DOUBLE) / sum(r) OVER (), 1e-6) AS r,
  greatest(CAST(c AS DOUBLE) / sum(c) OVER (), 1e-6) AS c FROM cnt),
psi AS (SELECT sum((c - r) * ln(c / r)) AS psi FROM sh)"""


def _halves(spark, sf_dir):
    tel = view(spark, sf_dir, "v_tel").select("ts", "avg_logprob")
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return tel.filter(early), tel.filter(~early)


@query("A36", q.cte("v_tel", extra=_PSI) + "SELECT round(psi, 6) AS psi FROM psi")
def confidence_psi(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    return operations.psi(before, after, "avg_logprob").select(F.round("psi", 6).alias("psi"))


_SHARES = f"""ns AS (SELECT store_id, noise_pred AS subtype, side, count(*) AS n FROM (SELECT *,
  CASE WHEN ts < {_HALF} THEN 0 ELSE 1 END AS side FROM v_tel) WHERE noise_pred IS NOT NULL
  GROUP BY ALL),
shares AS (SELECT store_id, subtype, side, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY store_id,
  side) AS s FROM ns),
wide AS (SELECT store_id, subtype, coalesce(max(s) FILTER (side = 0), 0) AS prev,
  coalesce(max(s) FILTER (side = 1), 0) AS cur FROM shares GROUP BY ALL),
fires AS (SELECT rule_fired AS rule_id, CAST(count(*) FILTER (ts >= {_HALF}) AS DOUBLE) AS week,
  count(*) / 4.0 AS mean FROM v_tel WHERE rule_fired IS NOT NULL GROUP BY 1)"""


def _half_shares(spark, sf_dir):
    tel = view(spark, sf_dir, "v_tel").filter(F.col("noise_pred").isNotNull())
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    counts = tel.groupBy("store_id", F.col("noise_pred").alias("subtype")).agg(
        F.sum((~late).cast("long")).alias("n0"), F.sum(late.cast("long")).alias("n1")
    )
    totals = counts.groupBy("store_id").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    return counts.join(totals, "store_id").select(
        "store_id",
        "subtype",
        F.coalesce(F.col("n0") / F.nullif(F.col("t0"), F.lit(0)), F.lit(0.0)).alias("prev"),
        F.coalesce(F.col("n1") / F.nullif(F.col("t1"), F.lit(0)), F.lit(0.0)).alias("cur"),
    )


def _fire_rates(spark, sf_dir):
    tel = view(spark, sf_dir, "v_tel").filter(F.col("rule_fired").isNotNull())
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return tel.groupBy(F.col("rule_fired").alias("rule_id")).agg(
        F.sum(late.cast("double")).alias("week"), (F.count(F.lit(1)) / 4.0).alias("mean")
    )


@query(
    "A37",
    q.cte("v_tel", "v_verdict", extra=f"{_PSI}, {_SHARES}")
    + """SELECT 'input_drift' AS type, NULL AS store_id, NULL AS subtype, NULL AS rule_id,
  round(psi, 4) AS value, NULL::DOUBLE AS prev, NULL::DOUBLE AS cur FROM psi WHERE psi > 0.0001
UNION ALL SELECT 'noise_drift', store_id, subtype, NULL, NULL, round(prev, 6), round(cur, 6)
  FROM wide WHERE prev > 0 AND cur >= 1.1 * prev
UNION ALL SELECT 'rule_storm', NULL, NULL, rule_id, NULL, NULL, NULL FROM fires
  WHERE mean > 0 AND week >= 1.9 * mean
UNION ALL SELECT 'quality_alarm', NULL, NULL, NULL, round(bad, 4), NULL, NULL FROM (
  SELECT avg(CASE WHEN verdict IN ('wrong', 'hallucination') THEN 1.0 ELSE 0.0 END) AS bad
  FROM v_verdict) WHERE bad > 0.1""",
)
def drift_alerts(spark, sf_dir):
    """All four monitors with sensitive limits, one typed row per alert."""
    before, after = _halves(spark, sf_dir)
    alerts = operations.all_alerts(
        operations.input_drift_alerts(operations.psi(before, after, "avg_logprob"), 0.0001),
        operations.noise_drift_alerts(_half_shares(spark, sf_dir), 1.1),
        operations.rule_storm_alerts(_fire_rates(spark, sf_dir), 1.9),
        operations.quality_alerts(view(spark, sf_dir, "v_verdict"), 0.1),
    )
    return alerts.select(
        "type", "store_id", "subtype", "rule_id", "value",
        F.round("prev", 6).alias("prev"), F.round("cur", 6).alias("cur"),
    )


@query(
    "A38 R2",
    q.cte("v_tel")
    + """, r AS (SELECT * FROM v_tel ORDER BY ts DESC, trace_id DESC LIMIT 500),
o AS (SELECT list(total_ms ORDER BY total_ms) AS l, count(*) AS n, avg(guarded) AS g FROM r)
SELECT n, l[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50,
  l[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95, round(g, 3) AS guarded_rate FROM o""",
)
def service_stats(spark, sf_dir):
    return operations.service_stats(view(spark, sf_dir, "v_tel"))


@query(
    "A39",
    q.cte("v_tel")
    + """, o AS (SELECT list(total_ms ORDER BY total_ms) AS l, count(*) AS n FROM v_tel)
SELECT n, l[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50,
  l[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95,
  l[least(n - 1, CAST(floor(n * 0.99) AS BIGINT)) + 1] AS p99 FROM o""",
)
def latency_figures(spark, sf_dir):
    return operations.latency_figures(view(spark, sf_dir, "v_tel"))


_NOW = "2001-01-01 00:00:00"
_FILES = f"""files AS (SELECT 'store-' || CAST(o_custkey % 8 AS VARCHAR) AS store_id,
  'raw/' || CAST(o_orderkey AS VARCHAR) || '.wav' AS path, o_orderkey AS uid,
  o_orderdate < TIMESTAMP '{_NOW}' - INTERVAL 90 DAY AS old FROM orders)"""


def _files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("store-"), (F.col("o_custkey") % 8).cast("string")).alias("store_id"),
        F.concat(F.lit("raw/"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("path"),
        F.col("o_orderkey").alias("utterance_id"),
        F.col("o_orderdate").cast("timestamp").alias("modified"),
    )


def _now():
    return F.lit(_NOW).cast("timestamp")


@query(
    "A41",
    f"""WITH {_FILES} SELECT store_id, count(*) AS scanned, CAST(count(*) FILTER (old) AS BIGINT)
  AS n_purged, CAST(count(*) FILTER (NOT old) AS BIGINT) AS kept FROM files GROUP BY store_id""",
)
def retention_report(spark, sf_dir):
    return operations.retention_report(_files(spark, sf_dir), _now())


@query("A41", f"WITH {_FILES} SELECT path FROM files WHERE old")
def purge_list(spark, sf_dir):
    return operations.purge_list(_files(spark, sf_dir), _now()).select("path")


@query(
    "A42",
    f"""WITH {_FILES} SELECT uid AS utterance_id, CAST(CASE WHEN old THEN 1 ELSE 0 END AS BIGINT)
  AS audio_purged FROM files""",
)
def soft_deleted(spark, sf_dir):
    files = _files(spark, sf_dir)
    marked = operations.mark_purged(files, operations.purge_list(files, _now()))
    return marked.select("utterance_id", F.col("audio_purged").cast("long").alias("audio_purged"))


# one request after the other per store: the accepted times of the window travel along
_LIMIT = """RECURSIVE req AS (SELECT store_id, trace_id, epoch_us(ts) / 1e6 AS at_, row_number()
  OVER (PARTITION BY store_id ORDER BY ts, trace_id) AS rn FROM v_tel),
walk AS (SELECT store_id, rn, trace_id, [at_] AS held, true AS accepted FROM req WHERE rn = 1
  UNION ALL SELECT r.store_id, r.rn, r.trace_id,
    CASE WHEN len(list_filter(w.held, lambda h: h >= r.at_ - {window})) < {limit}
      THEN list_append(list_filter(w.held, lambda h: h >= r.at_ - {window}), r.at_)
      ELSE list_filter(w.held, lambda h: h >= r.at_ - {window}) END,
    len(list_filter(w.held, lambda h: h >= r.at_ - {window})) < {limit}
  FROM walk w JOIN req r ON r.store_id = w.store_id AND r.rn = w.rn + 1)"""


def _limit_sql(window: int, limit: int) -> str:
    tel = VIEWS["v_tel"].sql()
    body = _LIMIT.replace("{window}", str(window)).replace("{limit}", str(limit))
    return body.replace("RECURSIVE req", f"RECURSIVE v_tel AS ({tel}), req", 1)


@query(
    "R1",
    f"WITH {_limit_sql(7200, 3)} SELECT store_id, trace_id, accepted FROM walk",
)
def rate_limited_requests(spark, sf_dir):
    """At most three accepted requests per store in two hours; rejected ones do not count."""
    tel = view(spark, sf_dir, "v_tel")
    return operations.rate_limit(tel, window_s=7200, limit=3)


def _event_stream(spark, sf_dir, files_per_trigger=64):
    schema = table(spark, sf_dir, "events").schema
    raw = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        # a pattern, as the table may be one file or a folder of files
        .parquet(f"{sf_dir}/event[s].parquet")
    )
    columns = [f"{expr} AS {name}" for name, expr in VIEWS["v_tel"].columns.items()]
    return raw.selectExpr(*columns).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "R1",
    f"WITH {_limit_sql(7200, 3)} SELECT store_id, trace_id, accepted FROM walk",
)
def rate_limited_stream(spark, sf_dir):
    """The same limit on a stream with keyed state."""
    own = jobs.stateful_session(spark)
    limited = jobs.rate_limit_stream(_event_stream(own, sf_dir), window_s=7200, limit=3)
    return jobs.run_to_table(spark, limited, "rate-limit", "append")


@query(
    "R2",
    q.cte("v_tel")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ts DESC) AS rn FROM v_tel),
o AS (SELECT store_id, list(total_ms ORDER BY total_ms) AS l, count(*) AS n, avg(guarded) AS g
  FROM r WHERE rn <= 100 GROUP BY store_id)
SELECT store_id, n, l[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50,
  l[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95, round(g, 3) AS guarded_rate FROM o""",
)
def rolling_service_stats(spark, sf_dir):
    """Figures over the newest hundred requests of each store, kept in stream state."""
    own = jobs.stateful_session(spark)
    stats = jobs.rolling_stats(_event_stream(own, sf_dir), keep=100)
    return jobs.run_to_table(spark, stats, "rolling-stats", "update", ["store_id"])


@query(
    "R3 S3",
    q.cte("v_tel")
    + """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CASE WHEN rule_fired IS NULL
  THEN 0 ELSE 1 END) AS BIGINT) AS n_rules FROM v_tel GROUP BY 1""",
)
def telemetry_stream_by_day(spark, sf_dir):
    """Stream the events into day folders, exactly once, and count what arrived."""
    lines = _event_stream(spark, sf_dir).select(
        "ts",
        F.col("trace_id").cast("string").alias("trace_id"),
        "store_id",
        "speech_ratio",
        "noise_pred",
        "avg_logprob",
        F.array_compact(F.array("rule_fired")).alias("rules_fired"),
        F.struct(F.col("total_ms").alias("total")).alias("latency_ms"),
    )
    base = work_folder(spark, "day-stream")
    jobs.append_by_day(lines, f"{base}/lines", f"{base}/checkpoint").awaitTermination()
    back = spark.read.schema("trace_id string, rules_fired array<string>, day string").json(
        f"{base}/lines"
    )
    return back.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.size("rules_fired") > 0).cast("long")).alias("n_rules"),
    )


@query(
    "R4 A34",
    q.cte("v_tel")
    + """, w AS (SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05'), '%Y-%m-%d')
  AS week_start, store_id, noise_pred, count(*) AS n FROM v_tel WHERE noise_pred IS NOT NULL
  GROUP BY ALL)
SELECT week_start, store_id, noise_pred, n, round(CAST(n AS DOUBLE) / sum(n) OVER (
  PARTITION BY week_start, store_id), 6) AS share FROM w""",
)
def weekly_noise_stream(spark, sf_dir):
    """Weekly windows over the event stream; the batch figures are the check."""
    stream = _event_stream(spark, sf_dir).filter(F.col("noise_pred").isNotNull())
    counts = jobs.run_to_table(
        spark,
        jobs.weekly_counts(stream, ["store_id", "noise_pred"]),
        "weekly",
        "update",
        ["week_start", "store_id", "noise_pred"],
    )
    shares = jobs.weekly_shares(counts, ["store_id"])
    return shares.select(
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
        "store_id",
        "noise_pred",
        "n",
        F.round("share", 6).alias("share"),
    )


