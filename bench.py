"""Wall time of the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = """track_rollup_alerting alert_lifecycle retrain_queue boundary_bytes p95_score containers_reporting latency_histogram span_pair
recent_traces asof_last_position nearest_frame interp_position_onto_imu window_label_center window_label_overlap event_interval_match
causal_rolling_mean trend_slope gap_cluster_events runs_min_k run_gate_wheels split_bursts integrate_yaw turntable_anchors
vibration_energy cum_distance_legpin track_health_map time_features spectral_shape l2_to_centroid robust_baseline_fit directed_score auc
roc_operating_points acl_audit gate_model parse_inference cm_to_pos log_info stage_machine stateful_asof""".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from beltline.plans import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("beltline-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or QUERIES

    def run(name: str) -> float:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("boundary_bytes")  # start the JVM side once
    times = {}
    for name in names:
        run(name)  # compiles
        times[name] = round(run(name), 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
