"""Feedback loop: harvest, verdict routing, rule lifecycle, noise profiles, cycle stages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soundquay import fixed
from soundquay.operators.corpus import control_sample
from soundquay.operators.order import latest_by_key


def route(verdict: Column, reference: Column, core_match: Column, confidence: Column) -> Column:
    """Where a judged item goes: training, training and mining, or human review."""
    return (
        F.when((verdict == "correct") & core_match, "training")
        .when(
            (verdict == "minor_errors")
            & (F.coalesce(reference, F.lit("")) != "")
            & (confidence >= fixed.ROUTE_MIN_CONFIDENCE),
            "training+miner",
        )
        .otherwise("review")
    )


ROUTES = ("training", "training+miner", "review")


def route_counts(routed: DataFrame, column: str = "route") -> DataFrame:
    """Items per route, zero for a route nobody took."""
    sums = [F.coalesce(F.sum((F.col(column) == r).cast("long")), F.lit(0)) for r in ROUTES]
    row = routed.agg(F.array(*sums).alias("_n"))
    return row.select(
        F.inline(
            F.arrays_zip(F.array(*[F.lit(r) for r in ROUTES]).alias("route"), F.col("_n").alias("n"))
        )
    )


def scripted_verdicts(requests: DataFrame, script: DataFrame, default: dict) -> DataFrame:
    """Verdict by transcript from a table, the default verdict otherwise."""
    known = script.select(
        "transcript", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in default]
    )
    joined = requests.join(known, "transcript", "left")
    filled = [
        F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.lit(v)).alias(c)
        for c, v in default.items()
    ]
    return joined.select(*requests.columns, *filled)


def judge_requests(
    transcripts: DataFrame, tickets: DataFrame, menu: DataFrame, n_items: int = fixed.JUDGE_MENU_ITEMS
) -> DataFrame:
    """Transcript, ticket of the order named in the metadata, and the first menu items."""
    ordered = menu.orderBy("ord").limit(n_items)
    items = ordered.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda s: s["term"]
        ).alias("menu_items")
    )
    keyed = transcripts.withColumn("order_id", F.get_json_object("meta_json", "$.pos_order_id"))
    return (
        keyed.join(tickets.select("order_id", F.col("items").alias("pos_ticket")), "order_id", "left")
        .crossJoin(F.broadcast(items))  # one row with at most n_items terms
    )


def evidence_join(
    transcriptions: DataFrame, corrections: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Transcriptions with their number of corrections and latest verdict."""
    counts = corrections.groupBy("transcription_id").agg(F.count(F.lit(1)).alias("n_rules"))
    last = latest_by_key(
        verdicts.select("transcription_id", "id", "verdict"), ["transcription_id"], ["id"]
    ).select("transcription_id", "verdict")
    return (
        transcriptions.join(counts, "transcription_id", "left")
        .join(last, "transcription_id", "left")
        .withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
    )


def harvest_reasons(
    min_logprob: float = fixed.HARVEST_LOGPROB, min_rules: int = fixed.HARVEST_MIN_RULES
) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("avg_logprob") < min_logprob, "low_logprob"),
            F.when(F.size("guard_flags") > 0, "guard_flags"),
            F.when(F.col("n_rules") >= min_rules, "rules_fired"),
            F.when(F.col("verdict") == "wrong", "judge_wrong"),
        )
    )


def harvest(
    evidence: DataFrame,
    min_logprob: float = fixed.HARVEST_LOGPROB,
    min_rules: int = fixed.HARVEST_MIN_RULES,
    control_share: float = fixed.CONTROL_SHARE,
    cap: int | None = fixed.HARVEST_CAP,
    seed: int = fixed.SEED,
) -> DataFrame:
    """The work list: doubtful items plus a control sample, in a fixed order, up to ``cap``."""
    marked = evidence.withColumn("reasons", harvest_reasons(min_logprob, min_rules))
    doubtful = marked.filter(F.size("reasons") > 0).select(
        "utterance_id", "transcription_id", F.array_join("reasons", ",").alias("reasons")
    )
    rest = marked.filter(F.size("reasons") == 0).select("utterance_id")
    control = control_sample(rest, "utterance_id", control_share, seed).select(
        "utterance_id",
        F.lit(None).cast(dict(evidence.dtypes)["transcription_id"]).alias("transcription_id"),
        F.lit("control").alias("reasons"),
    )
    work = doubtful.unionByName(control)
    if cap is None:
        return work
    return work.orderBy("utterance_id", "reasons").limit(cap)


def advance_rules(
    rules: DataFrame,
    evidence: DataFrame,
    min_weeks: int = fixed.RULE_MIN_WEEKS,
    min_fires: int = fixed.RULE_MIN_FIRES,
) -> DataFrame:
    """Rule states after the cycle; approved rules with enough clean evidence become active."""
    seen = rules.join(evidence, "rule_id", "left")
    ready = (
        (F.col("status") == "approved")
        & (F.coalesce("weeks_approved", F.lit(0)) >= min_weeks)
        & (F.coalesce("correct_fires", F.lit(0)) >= min_fires)
        & (F.coalesce("conflicts", F.lit(0)) == 0)
    )
    return seen.select(
        "rule_id",
        F.col("status").alias("old_status"),
        F.when(ready, "active").otherwise(F.col("status")).alias("new_status"),
    )


def transitions(advanced: DataFrame) -> DataFrame:
    return advanced.filter(F.col("old_status") != F.col("new_status"))


def noise_profiles(telemetry: DataFrame) -> DataFrame:
    """Weekly share of each predicted subtype per store, with the dominant one."""
    counts = (
        telemetry.filter(F.col("noise_pred").isNotNull())
        .groupBy("store_id", F.date_trunc("week", "ts").alias("week"), "noise_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("store_id", "week").agg(
        F.sum("n").alias("n_total"),
        F.max(F.struct("n", F.col("noise_pred"))).alias("_top"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("noise_pred", "n")))).alias("counts"),
    ).select(
        "store_id",
        "week",
        "n_total",
        "counts",
        F.col("_top.noise_pred").alias("dominant"),
        (F.col("_top.n") / F.col("n_total")).alias("dominant_share"),
    )


def noise_shift_flags(
    profiles: DataFrame, multiplier: float = fixed.SHARE_MULTIPLIER
) -> DataFrame:
    """Weeks in which the dominant share of a store at least doubled (no flag without a past)."""
    # profiles hold one row per store and week
    by_store = Window.partitionBy("store_id").orderBy("week")
    previous = F.lag("dominant_share").over(by_store)
    return profiles.withColumn("prev_dominant_share", previous).filter(
        F.col("dominant_share") >= multiplier * F.col("prev_dominant_share")
    )


def retrain_trigger(pool: DataFrame, hours: float = fixed.RETRAIN_HOURS) -> DataFrame:
    total = F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 3600.0
    return pool.agg(total.alias("pool_hours")).withColumn("triggered", F.col("pool_hours") >= hours)


def judge_agreement(
    verdicts: DataFrame,
    gold: DataFrame,
    min_agreement: float = fixed.JUDGE_MIN_AGREEMENT,
    min_items: int = fixed.JUDGE_MIN_ITEMS,
) -> DataFrame:
    """Agreement of the judge with known verdicts; trusted from enough items on."""
    both = verdicts.select("transcription_id", "verdict").join(
        gold.select("transcription_id", F.col("verdict").alias("gold")), "transcription_id"
    )
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("verdict") == F.col("gold")).cast("double")).alias("agreement"),
    ).withColumn(
        "calibrated",
        (F.col("n") >= min_items) & F.coalesce(F.col("agreement") >= min_agreement, F.lit(False)),
    )


def pending_reviews(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("status") == "pending")


def resolve_reviews(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Apply the last resolution of each item; items without one stay as they are."""
    last = latest_by_key(resolutions, ["id"], ["resolved_at"]).select(
        "id",
        F.col("status").alias("_status"),
        F.col("reviewer_note").alias("_note"),
        F.col("resolved_at").alias("_at"),
    )
    joined = queue.join(last, "id", "left")
    new = {"status": "_status", "reviewer_note": "_note", "resolved_at": "_at"}
    return joined.select(
        *[
            F.coalesce(F.col(new[c]), F.col(c)).alias(c) if c in new else F.col(c)
            for c in queue.columns
        ]
    )


def fingerprint(tables: Sequence[DataFrame]) -> str:
    """A digest of the contents of tables, whatever the order of their rows."""
    marks = []
    for df in tables:
        columns = sorted(c for c, kind in df.dtypes if "map<" not in kind)
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        marks.append(f"{columns}:{row[0]}:{row[1]}")
    return hashlib.md5("|".join(marks).encode()).hexdigest()


class CycleStages:
    """Steps of a cycle kept as Parquet tables under ``root/<cycle_id>/<step>/<inputs>``.

    A step names the tables it reads, and its own table is filed under their fingerprint. A finished
    step (marked by the job's ``_SUCCESS`` file) is read back instead of computed, so an interrupted
    cycle goes on where it stopped, also after executors or the driver were lost; when an input
    has changed, the step and those that read its result are computed again, as far as results differ.
    """

    def __init__(self, spark: SparkSession, root: str, cycle_id: str) -> None:
        self.spark = spark
        self.base = f"{root.rstrip('/')}/{cycle_id}"
        self.built: list[str] = []

    def _is_done(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(marker)

    def run(self, step: str, build: Callable[[], DataFrame], *inputs: DataFrame) -> DataFrame:
        path = f"{self.base}/{step}/{fingerprint(inputs)}"
        if not self._is_done(path):
            build().write.mode("overwrite").parquet(path)
            self.built.append(step)
        return self.spark.read.parquet(path)


def cycle_summary(
    cycle_id: str,
    worklist: DataFrame,
    routes: DataFrame,
    mined: DataFrame,
    flags: DataFrame,
    retrain: DataFrame,
    decision: DataFrame,
) -> DataFrame:
    """One row that sums up a cycle; every part is itself one aggregated row."""
    n_routes = routes.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("route") == r, F.col("n"))), F.lit(0)).alias(name)
            for r, name in zip(ROUTES, ("n_training", "n_miner", "n_review"), strict=True)
        ]
    )
    out = worklist.agg(F.count(F.lit(1)).alias("n_harvested"))
    for part in (
        n_routes,
        mined.agg(F.count(F.lit(1)).alias("n_candidates")),
        flags.agg(F.count(F.lit(1)).alias("n_noise_flags")),
        retrain.select("pool_hours", F.col("triggered").alias("retrain")),
        decision.select("promote"),
    ):
        out = out.crossJoin(part)  # one row each
    return out.withColumn("cycle_id", F.lit(cycle_id))
