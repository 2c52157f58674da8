"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2): each
query is run BENCH_RUNS times to completion and the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "win01_resample_counts", "win01_resample_per_user", "win03_rolling_median",
    "win12_lag_frames", "win17_sequence_batches",
    "sta01_standardise", "sta05_adf_test", "sta07_acf", "sta09_decompose_24",
    "sta13_order_search", "sta15_generate_forecasts", "sta16_iterated_forecast",
    "sta17_per_user_forecast", "sta21_detect_anomalies", "sta24_anomaly_chart",
    "agg03_group_mean", "agg04_describe", "agg05_group_describe", "agg18_quantiles",
    "agg20_daily_class_pivot", "agg22_correlation_matrix", "agg26_histogram", "agg27_box_summary",
    "prj08_filter_and_or", "prj14_reset_index", "nul08_fill_group_mean",
    "jon01_aligned_arithmetic", "jon05_concat_columns", "ord03_top_k", "set03_drop_duplicates",
    "fun21_encode_characters", "src17_from_message", "src11_html_lists",
    "ml02_tf_idf", "ml03_logistic_regression", "ml05_roc_auc_ovo", "ml07_classification_report",
    "str06_stream_resample", "str08_stream_anomalies",
]


def main() -> None:
    from tidegauge import queries as registry
    from tidegauge.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    registry.load_all()
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            # every row and column is produced; nothing is pulled to the driver
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds_headline_queries",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
