"""Operations: drift, alerts, latency figures, retention, telemetry projection, rate limits."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.operators.order import values_at_shares

TELEMETRY_COLUMNS = (
    "ts", "trace_id", "store_id", "duration_s", "speech_ratio", "noise_pred",
    "noise_confidence", "chain_applied", "language", "avg_logprob", "guard_flags",
    "rules_fired", "latency_ms", "model_version",
)
STAGES = ("vad", "preprocess", "asr", "keydetector")
# names that may never leave with a telemetry line
TEXT_COLUMNS = ("text", "raw_text", "final_text", "transcript", "corrected")


def stage_total(gated: Column, stages: dict[str, Column]) -> Column:
    """Sum of the stage times, missing ones 0; a gated request only paid for the speech check."""
    total = F.lit(0.0)
    for value in stages.values():
        total = total + F.coalesce(value, F.lit(0.0))
    return F.when(gated, F.coalesce(stages["vad"], F.lit(0.0))).otherwise(total)


def telemetry_lines(df: DataFrame) -> DataFrame:
    """The rounded telemetry columns and nothing else: no text of the customer."""
    kept = [c for c in TELEMETRY_COLUMNS if c in df.columns]
    places = {"duration_s": 3, "speech_ratio": 3, "noise_confidence": 3, "avg_logprob": 3}
    out = df.select(
        *[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in kept]
    )
    if "latency_ms" in kept:
        kind = dict(df.dtypes)["latency_ms"]
        if kind.startswith("map"):
            rounded = F.transform_values("latency_ms", lambda _, v: F.round(v, 1))
        else:
            names = df.schema["latency_ms"].dataType.names
            rounded = F.struct(*[F.round(f"latency_ms.{n}", 1).alias(n) for n in names])
        out = out.withColumn("latency_ms", rounded)
    leaked = set(out.columns) & set(TEXT_COLUMNS)
    if leaked:
        raise ValueError(f"text columns in telemetry: {sorted(leaked)}")
    return out


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = fixed.PSI_BINS) -> DataFrame:
    """Population stability index of two samples over equal-width bins of their joint range.

    Two small aggregations over the values: the range, then the counts per bin.
    """
    both = reference.select(F.col(value).alias("_x"), F.lit(0).alias("_side")).unionByName(
        current.select(F.col(value).alias("_x"), F.lit(1).alias("_side"))
    ).filter(F.col("_x").isNotNull())
    low_high = both.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).select(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    binned = both.crossJoin(F.broadcast(low_high)).withColumn(  # one row
        "_bin",
        F.least(
            F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
            F.lit(bins - 1),
        ),
    )
    counts = binned.groupBy("_bin").agg(
        F.sum((F.col("_side") == 0).cast("long")).alias("_r"),
        F.sum((F.col("_side") == 1).cast("long")).alias("_c"),
    )
    grid = reference.sparkSession.range(bins).withColumnRenamed("id", "_bin")
    shares = grid.join(counts, "_bin", "left").na.fill(0, ["_r", "_c"])
    totals = shares.agg(F.sum("_r").alias("_tr"), F.sum("_c").alias("_tc"))
    def share(n: str, total: str) -> Column:
        return F.greatest(F.col(n) / F.greatest(F.col(total), F.lit(1)), F.lit(fixed.PSI_EPS))

    part = (share("_c", "_tc") - share("_r", "_tr")) * F.log(
        share("_c", "_tc") / share("_r", "_tr")
    )
    return shares.crossJoin(totals).agg(  # ten bins, one row of totals
        F.when((F.max("_tr") > 0) & (F.max("_tc") > 0), F.sum(part)).otherwise(0.0).alias("psi")
    )


def input_drift_alerts(psi_row: DataFrame, limit: float = fixed.PSI_ALERT) -> DataFrame:
    return psi_row.filter(F.col("psi") > limit).select(
        F.lit("input_drift").alias("type"),
        F.round("psi", 4).alias("value"),
        F.lit(limit).alias("threshold"),
    )


def noise_drift_alerts(shares: DataFrame, multiplier: float = fixed.SHARE_MULTIPLIER) -> DataFrame:
    """``store_id, subtype, prev, cur``: shares that at least doubled from a positive one."""
    return shares.filter(
        (F.col("prev") > 0) & (F.col("cur") >= multiplier * F.col("prev"))
    ).select(F.lit("noise_drift").alias("type"), "store_id", "subtype", "prev", "cur")


def rule_storm_alerts(rates: DataFrame, multiplier: float = fixed.STORM_MULTIPLIER) -> DataFrame:
    """``rule_id, week, mean``: rules that fire far above their mean."""
    return rates.filter(
        (F.col("mean") > 0) & (F.col("week") >= multiplier * F.col("mean"))
    ).select(F.lit("rule_storm").alias("type"), "rule_id", "week", "mean")


def quality_alerts(verdicts: DataFrame, limit: float = fixed.BAD_VERDICT_SHARE) -> DataFrame:
    bad = F.avg(F.col("verdict").isin("wrong", "hallucination").cast("double"))
    return verdicts.agg(bad.alias("_bad")).filter(F.col("_bad") > limit).select(
        F.lit("quality_alarm").alias("type"),
        F.round("_bad", 4).alias("value"),
        F.lit(limit).alias("threshold"),
    )


def all_alerts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def service_stats(
    telemetry: DataFrame, order: str = "ts", recent: int | None = fixed.RECENT_REQUESTS
) -> DataFrame:
    """Request count, latency p50 and p95 and guarded share over the newest requests."""
    rows = telemetry.select(order, "trace_id", "total_ms", "guarded")
    if recent is not None:
        rows = rows.orderBy(F.desc(order), F.desc("trace_id")).limit(recent)
    rates = rows.agg(F.round(F.avg(F.col("guarded").cast("double")), 3).alias("guarded_rate"))
    return values_at_shares(rows, "total_ms", {"p50": 0.5, "p95": 0.95}).crossJoin(rates)


def latency_figures(telemetry: DataFrame) -> DataFrame:
    known = telemetry.filter(F.col("total_ms").isNotNull())
    return values_at_shares(known, "total_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def retention_report(
    files: DataFrame, now: Column, days: int = fixed.RETENTION_DAYS
) -> DataFrame:
    """Files per store: scanned, to purge, kept (``store_id, path, modified``)."""
    old = F.col("modified") < now - F.expr(f"INTERVAL {days} DAYS")
    return files.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.sum(old.cast("long")).alias("n_purged"),
        F.sum((~old).cast("long")).alias("kept"),
    )


def purge_list(files: DataFrame, now: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """The files beyond the cutoff, one row each: a list column would not scale."""
    return files.filter(F.col("modified") < now - F.expr(f"INTERVAL {days} DAYS"))


def mark_purged(utterances: DataFrame, purged: DataFrame) -> DataFrame:
    """Flag rows whose audio is gone; the rows and their metrics stay."""
    gone = purged.select("utterance_id").distinct().withColumn("_gone", F.lit(1))
    return (
        utterances.join(gone, "utterance_id", "left")
        .withColumn("audio_purged", F.coalesce("_gone", F.lit(0)))
        .drop("_gone")
    )


def run_trend(runs: DataFrame, keep: int = 20) -> DataFrame:
    """Newest runs with the first known word error rate of their metrics document."""
    metrics = F.from_json("metrics_json", "map<string, struct<wer: double>>")
    first = F.get(
        F.filter(F.map_values(metrics), lambda m: m["wer"].isNotNull()), F.lit(0)
    )["wer"]
    return (
        runs.select("run_id", "model_version", "dataset_id", first.alias("wer"), "created_at")
        .orderBy(F.desc("created_at"), F.desc("run_id"))
        .limit(keep)
    )


def latest_runs(runs: DataFrame, keep: int = 1) -> DataFrame:
    """The last run ids by name."""
    return runs.filter(F.col("run_id").startswith("run-")).orderBy(F.desc("run_id")).limit(keep)


#: The name under which requests without a store are limited.
UNNAMED_STORE = "_anon"


def _busy_runs(events: DataFrame, limit: int) -> DataFrame:
    """The slots to walk, as _store, _slot and _run, the run of neighbouring slots they belong to.

    A slot is as long as the window, so what counts for an event lies in its slot and in the one
    before. Slots that hold no more than ``limit`` events with the slot before are quiet: nothing in
    them can be rejected. The others are walked, in runs; a run starts with the quiet slot before it,
    which gives the walk its first accepted times.
    """
    sizes = events.filter("_slot IS NOT NULL").groupBy("_store", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    # one row per store and slot that has events
    in_order = Window.partitionBy("_store").orderBy("_slot")
    near = F.col("_slot") - 1
    ahead = F.when(F.lag("_slot").over(in_order) == near, F.lag("_n").over(in_order))
    busy = sizes.withColumn("_busy", F.col("_n") + F.coalesce(ahead, F.lit(0)) > limit)
    leads = (F.lead("_slot").over(in_order) == F.col("_slot") + 1) & F.lead("_busy").over(in_order)
    kept = busy.withColumn("_lead", ~F.col("_busy") & F.coalesce(leads, F.lit(False))).filter("_busy OR _lead")
    starts = F.col("_lead") | F.coalesce(F.lag("_slot").over(in_order) != near, F.lit(True))
    return kept.select("_store", "_slot", F.sum(starts.cast("long")).over(in_order).alias("_run"))


def _walk(window: int, limit: int):
    """Accept the events of each run, from rows in the order of _store, _run, _at and trace_id."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, accepted = None, deque()
        for batch in batches:
            if not batch.num_rows:
                continue
            stores = batch.column("_store").to_numpy(zero_copy_only=False)
            runs = batch.column("_run").to_numpy()
            times = batch.column("_at").to_pylist()
            changes = np.flatnonzero((stores[1:] != stores[:-1]) | (runs[1:] != runs[:-1])) + 1
            ok = np.zeros(len(times), bool)
            for start, stop in pairwise([0, *changes.tolist(), len(times)]):
                if (stores[start], runs[start]) != current:
                    current, accepted = (stores[start], runs[start]), deque()
                i = start
                while limit > 0 and i < stop:
                    if len(accepted) == limit:  # all is rejected until the oldest one leaves the window
                        i = bisect_right(times, accepted[0] + window, i, stop)
                        if i == stop:
                            break
                        accepted.popleft()
                    ok[i] = True
                    accepted.append(times[i])
                    i += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("store_id"), batch.column("trace_id"), pa.array(ok)],
                names=["store_id", "trace_id", "accepted"],
            )

    return walk


def rate_limit(
    requests: DataFrame,
    window_s: int = fixed.RATE_WINDOW_S,
    limit: int = fixed.RATE_LIMIT,
    time: str = "ts",
) -> DataFrame:
    """Accept a request when fewer than ``limit`` were accepted in the last ``window_s`` seconds.

    Rejected requests do not count, so the rule is sequential, but only while a store is near the
    limit. Time slots in which nothing can be rejected are found by their counts and need no Python;
    each run of other slots is walked on its own. The walk streams over sorted batches, keeps at
    most ``limit`` times and goes from one accepted request to the next by bisection, so that its
    work does not grow with the number of requests in a window. Requests without a store are limited
    together, under one name; requests without a time are accepted.
    """
    width = window_s * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    store = F.coalesce(F.col("store_id").cast("string"), F.lit(UNNAMED_STORE))
    events = requests.select(store.alias("_store"), "store_id", "trace_id", at.alias("_at")).withColumn(
        "_slot", F.floor(F.col("_at") / width).cast("long")
    )
    placed = events.join(_busy_runs(events, limit), ["_store", "_slot"], "left")
    quiet = placed.filter("_run IS NULL").select("store_id", "trace_id", F.lit(True).alias("accepted"))
    kinds = dict(requests.dtypes)
    walked = (
        placed.filter("_run IS NOT NULL")
        .select("_store", "store_id", "_run", "_at", "trace_id")
        .repartition("_store", "_run")
        .sortWithinPartitions("_store", "_run", "_at", "trace_id")
        .mapInArrow(
            _walk(width, limit),
            f"store_id {kinds['store_id']}, trace_id {kinds['trace_id']}, accepted boolean",
        )
    )
    return quiet.unionByName(walked)
