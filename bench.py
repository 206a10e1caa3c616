"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from tapeline.plans import load_all
from tapeline.session import local_session

HEADLINE = [
    "flagship_band_signal", "s02_bar_builder", "w01_sma", "w02_ema", "w04_rsi", "w10_bollinger", "w17_adx", "w21_supertrend", "w23_catalogue", "w25_equity",
    "p18_trend_state", "j01_asof", "j03_first_touch", "a14_transition_matrix", "a25_conditional_features", "a32_f_score", "r01_risk_metrics", "r07_covariance",
    "r15_signal_ledger", "r19_regression_report", "r30_average_cost", "f01_sax", "f06_cwt", "f13_spectra", "a28_pair_summary", "j05_nearest_references", "m05_regime_features", "m18_forecast_tree",
    "d01_window_patterns", "d10_subsequence_search", "d14_sax_shapelets", "d17_shapelet_transform", "d29_feature_table", "f14_pattern_vector", "f20_fast_dtw",
]


def main():
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = load_all().QUERIES
    queries["a08_counts_over_time"](spark, root).write.format("noop").mode("overwrite").save()  # start-up, not measured
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": root.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
