"""Structured Streaming forms: telemetry append, weekly windows, rolling figures, rate limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from soundquay import fixed
from soundquay.operators.operations import UNNAMED_STORE, telemetry_lines
from soundquay.operators.order import latest_by_key
from soundquay.sources.stage import work_folder


def append_by_day(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Telemetry lines to JSON under their day; exactly once through the checkpoint."""
    lines = telemetry_lines(stream).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return (
        lines.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )


def weekly_counts(stream: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Counts per week from Monday on; weeks closed for ``late`` behind the newest event take no
    more rows. Run it in update mode, keeping the newest count of each week and key."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", "7 days", startTime="4 days"), *key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("week_start"), *key, "n")
    )


def weekly_shares(counts: DataFrame, within: list[str]) -> DataFrame:
    """Shares of finished weekly counts (batch step over the sink table)."""
    totals = counts.groupBy("week_start", *within).agg(F.sum("n").alias("_total"))
    return counts.join(totals, ["week_start", *within]).withColumn(
        "share", F.col("n") / F.col("_total")
    ).drop("_total")


#: The state store that keyed state needs.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store for keyed state; the caller's stays as it is."""
    own = spark.newSession()
    for name, value in STATE_STORE.items():
        own.conf.set(name, value)
    return own


def run_to_table(
    spark: SparkSession,
    stream: DataFrame,
    name: str,
    output_mode: str = "append",
    key: list[str] | None = None,
) -> DataFrame:
    """Run a stream over all input there is and read its result back.

    Results go through ``foreachBatch`` to a folder per batch. A batch that is repeated after a
    failure overwrites its own folder. In update mode the newest row of each ``key`` counts.
    """
    if output_mode == "update" and not key:
        raise ValueError("update mode needs the key whose newest row counts")
    base = work_folder(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")
    if output_mode == "update":
        out = latest_by_key(out, key, ["batch"])
    return out.drop("batch")


def _limiter(window_s: int, limit: int):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    width = window_s * 1_000_000

    class Limiter(StatefulProcessor):
        """Keeps the accepted times of the last window per store (at most ``limit`` of them)."""

        def init(self, handle) -> None:
            self.accepted = handle.getListState("accepted", "at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803
            times = deque(t[0] for t in self.accepted.get()) if self.accepted.exists() else deque()
            # two columns of the rows of one store in one trigger; limit the trigger's size
            batch = pd.concat([r[["at", "trace_id"]] for r in rows]).sort_values(["at", "trace_id"])
            marks = []
            for at in batch["at"]:
                while times and times[0] < at - width:
                    times.popleft()
                marks.append(len(times) < limit)
                if marks[-1]:
                    times.append(at)
            yield pd.DataFrame(
                {
                    "store_id": None if key[0] == UNNAMED_STORE else key[0],
                    "trace_id": batch["trace_id"].to_numpy(),
                    "accepted": marks,
                }
            )
            if times:
                self.accepted.put([(int(t),) for t in times])
            else:
                self.accepted.clear()

        def close(self) -> None:
            pass

    return Limiter()


def rate_limit_stream(
    stream: DataFrame, window_s: int = fixed.RATE_WINDOW_S, limit: int = fixed.RATE_LIMIT
) -> DataFrame:
    """Live rate limit per store; needs the state store of ``STATE_STORE``.

    Rows are taken in arrival order from trigger to trigger, in time order inside a trigger, so the
    result is that of the batch form when triggers follow each other in time. The rows of a store
    in one trigger are sorted in memory: set ``maxBytesPerTrigger`` on the source. Rows without a
    store are limited together; stores are text.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = dict(stream.dtypes)
    return (
        stream.select(
            F.coalesce(F.col("store_id").cast("string"), F.lit(UNNAMED_STORE)).alias("store_id"),
            "trace_id",
            at.alias("at"),
        )
        .groupBy("store_id")
        .transformWithStateInPandas(
            statefulProcessor=_limiter(window_s, limit),
            outputStructType=(
                f"store_id string, trace_id {kinds['trace_id']}, accepted boolean"
            ),
            outputMode="Append",
            timeMode="None",
        )
    )


def _ring(keep: int):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Ring(StatefulProcessor):
        """The newest ``keep`` requests of a key and their figures after each batch."""

        def init(self, handle) -> None:
            self.recent = handle.getListState("recent", "at double, total_ms double, guarded int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803
            held = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
            for batch in rows:
                held += list(batch[["at", "total_ms", "guarded"]].itertuples(index=False, name=None))
                held = sorted(held)[-keep:]
            self.recent.put([(float(a), float(t), int(g)) for a, t, g in held])
            order = sorted(t for _, t, _ in held)
            n = len(order)
            yield pd.DataFrame(
                {
                    "store_id": [key[0]],
                    "n": [n],
                    "p50": [order[n // 2]],
                    "p95": [order[min(n - 1, int(0.95 * n))]],
                    "guarded_rate": [round(sum(g for _, _, g in held) / n, 3)],
                }
            )

        def close(self) -> None:
            pass

    return Ring()


def rolling_stats(stream: DataFrame, keep: int = fixed.RECENT_REQUESTS) -> DataFrame:
    """Figures over the newest ``keep`` requests per store; state is bounded by ``keep``."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    kinds = dict(stream.dtypes)
    return (
        stream.select("store_id", at.alias("at"), "total_ms", F.col("guarded").cast("int").alias("guarded"))
        .groupBy("store_id")
        .transformWithStateInPandas(
            statefulProcessor=_ring(keep),
            outputStructType=(
                f"store_id {kinds['store_id']}, n long, p50 double, p95 double, guarded_rate double"
            ),
            outputMode="Update",
            timeMode="None",
        )
    )
