"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from soundquay.plans import load_catalogue  # noqa: E402

HEADLINES = (
    "damage_ranking",
    "metric_bundle",
    "mitigation_policy",
    "corpus_error_rates",
    "keyword_error_rates",
    "normalized_texts",
    "english_sound_keys",
    "transcript_guard",
    "corrected_orders",
    "rule_matches",
    "mined_confusions",
    "noise_grid",
    "training_draw",
    "harvest_all",
    "resolved_reviews",
    "confidence_psi",
    "latency_figures",
    "rate_limited_requests",
    "weekly_noise_stream",
    "noise_mixes",
    "segments_outside_speech",
    "fuzzy_terms",
    "looped_noise",
    "rolling_service_stats",
    "rate_limited_stream",
    "cycle_summary",
)
WARM_UP = ("damage_ranking", "normalized_texts")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="soundquay-bench-")  # one machine: local and shared are the same
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("soundquay-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    catalogue = load_catalogue()
    only = sys.argv[1:]
    for name in WARM_UP:  # start the session and compile common code before timing
        catalogue[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only or HEADLINES:
        start = time.perf_counter()
        catalogue[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
