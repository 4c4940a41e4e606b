"""Streams give the batch result whatever the number of triggers, also over a folder of files."""

import os

import pytest
from pyspark.sql import functions as F

from soundquay.operators import operations, order
from soundquay.plans import load_catalogue
from soundquay.plans.operation_queries import _event_stream
from soundquay.plans.views import view
from soundquay.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The events as four files, one after the other in time."""
    root = tmp_path_factory.mktemp("tables")
    target = root / "events.parquet"
    target.mkdir()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values("ts")
    size = -(-len(events) // 4)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for i in range(4):
        part = spark.createDataFrame(events.iloc[i * size : (i + 1) * size], schema)
        part.coalesce(1).write.parquet(str(root / f"part{i}"))
        (name,) = [n for n in os.listdir(root / f"part{i}") if n.endswith(".parquet")]
        os.rename(root / f"part{i}" / name, target / f"{i}.parquet")
        os.utime(target / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    return str(root)


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


@pytest.mark.parametrize("name", ["rolling_service_stats", "telemetry_stream_by_day", "weekly_noise_stream"])
def test_folder_tables(spark, sf_dir, folder, name):
    build = load_catalogue()[name].build
    assert _rows(build(spark, folder)) == _rows(build(spark, sf_dir))


def test_rolling_figures_over_many_triggers(spark, folder):
    own = jobs.stateful_session(spark)
    stats = jobs.rolling_stats(_event_stream(own, folder, 1), keep=100)
    got = jobs.run_to_table(spark, stats, "rolling-test", "update", ["store_id"])
    assert _rows(got) == _rows(load_catalogue()["rolling_service_stats"].build(spark, folder))


def test_rate_limit_over_many_triggers(spark, folder):
    own = jobs.stateful_session(spark)
    limited = jobs.rate_limit_stream(_event_stream(own, folder, 1), window_s=7200, limit=3)
    got = jobs.run_to_table(spark, limited, "limit-test")
    want = operations.rate_limit(view(spark, folder, "v_tel"), window_s=7200, limit=3)
    assert _rows(got) == _rows(want)


def test_requests_without_a_store_are_limited_together(spark):
    rows = [(s, i, 1_700_000_000 + i) for i in range(20) for s in ("a", None)]
    df = spark.createDataFrame(rows, "store_id string, trace_id long, at long").select(
        "store_id", "trace_id", F.timestamp_seconds("at").alias("ts")
    )
    out = operations.rate_limit(df, window_s=60, limit=3).filter("accepted").groupBy("store_id").count()
    assert {r["store_id"]: r["count"] for r in out.collect()} == {"a": 3, None: 3}


def test_weeks_start_on_monday_and_late_rows_are_left_out(spark, tmp_path):
    # the last one comes two months late; Spark drops rows by the watermark of the trigger before
    days = ["2024-01-02", "2024-01-08", "2024-03-05", "2024-03-06", "2024-01-03"]
    for i, day in enumerate(days):
        df = spark.createDataFrame([(day, "s")], "d string, store_id string")
        df.select(F.to_timestamp("d").alias("ts"), "store_id").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (name,) = [n for n in os.listdir(tmp_path / f"w{i}") if n.endswith(".parquet")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(tmp_path / f"w{i}" / name, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    stream = (
        spark.readStream.schema("ts timestamp, store_id string").option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    counts = jobs.run_to_table(
        spark, jobs.weekly_counts(stream, ["store_id"]), "weeks", "update", ["week_start", "store_id"]
    )
    got = {str(r["week_start"])[:10]: r["n"] for r in counts.collect()}
    assert got == {"2024-01-01": 1, "2024-01-08": 1, "2024-03-04": 2}


def test_shared_values_spread_over_partitions(spark):
    df = spark.range(200_000).select("id", (F.col("id") % 1000).alias("v"))
    out = order.number_rows(df, ["v"], buckets=16)
    assert out.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()[0:3] == (0, 199_999, 200_000)
    sizes = df.withColumn("tie", F.xxhash64("id", "v")).repartitionByRange(16, "v", "tie")
    counts = [r["count"] for r in sizes.groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) <= 3 * sum(counts) / len(counts)


def test_shares_follow_counts_per_value(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(1000)], "v long")
    got = order.values_at_shares(df, "v", {"a": 0.5, "b": 0.95, "c": 0.0}).first()
    values = sorted(i % 7 for i in range(1000))
    assert (got["n"], got["a"], got["b"], got["c"]) == (1000, values[500], values[950], values[0])
