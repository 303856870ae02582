"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINES = [
    "A2_numeric_describe", "A3_categorical_profile", "A8_numeric_target_profile", "A12_series_quality", "A15_daily_panel",
    "A16_daily_rollups", "A18_resample_weekly", "A21_frequency_diagnosis", "W1_lags", "W2_rolling_basic",
    "W3_rolling_quantiles", "W4_rolling_shape", "W6_ewm", "W10_rolling_trend", "W13_seasonal_decompose", "W16_regularise_daily",
    "W19_holdout_fraction", "E2_stratified_split", "E6_regression_metrics", "E7_classification_metrics",
    "E10_ensemble_regression", "R9_filter_features_generic", "R13_mutual_information", "X2_label_encode",
    "X9_preprocess_fitted", "Q7_seasonal_naive", "Q11_per_series_metrics", "Q15_ts_cross_validate",
    "Q4_forecast_exp_smoothing", "M8_knn_neighbours", "M11_dbscan", "F15_response_cleanup",
]


def main() -> None:
    from tabloom.plans import registry
    from tabloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry.load_all()
    # one untimed query: the session, the page cache and the first code generation are not the first query's cost
    registry.QUERIES["A15_daily_panel"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
