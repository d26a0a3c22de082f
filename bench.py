"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from motionlake.plans import catalogue

QUERIES = ["velocities", "trajectory_jump", "object_deformation", "clip_scores", "resample_linear", "fixed_bins", "utterance_alignment", "kpi_block", "stage_funnel", "bench_aggregate", "output_hash", "tumbling_counts", "session_windows", "motion_segments"]

#: Timed as well, outside the total, which stays comparable over rounds.
MORE = ["tracker_rows", "channel_grid", "motion_primitives", "camera_offsets", "leg_series", "frame_documents", "robot_joints", "usable_series", "stage_reports", "reference_assets", "subtask_segments", "crosschecks", "video_probe", "archive_members"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalogue.queries(), {}
    found["kpi_block"](spark, sf_dir).collect()  # starts the engine
    for name in QUERIES + MORE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took[n] for n in QUERIES), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
