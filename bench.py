"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1); BENCH_CPUS: local threads.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = (
    "profile_describe",
    "features_train",
    "features_serve_lineitem",
    "features_train_one_series",
    "alert_timeline",
    "warning_streak_one_series",
    "calibration_best",
    "run_metrics",
    "roc_curve_sliced",
    "score_density_binned",
    "threshold_sweep",
    "chronological_split",
    "stratified_folds",
    "robust_scaler",
    "stratified_split",
    "train_risk_model",
    "train_mode_models",
    "stream_timeline",
)
# rows read by a query, for the rows-per-second figures
INPUT = {n: "lineitem" if "lineitem" in n or n in ("profile_describe", "robust_scaler", "train_mode_models") else "events" for n in HEADLINE}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetpulse-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from fleetpulse.plans.checks import QUERIES

    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(INPUT.values())}
    # the JVM's start and first compilations belong to no query
    QUERIES["alert_timeline"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, speed = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        speed[name] = round(counts[INPUT[name]] / seconds[name])
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "input_rows_per_sec": speed,
            }
        )
    )


if __name__ == "__main__":
    main()
