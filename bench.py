"""Headline queries on one machine: prints one JSON line with wall seconds per query."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wattloom.session import local_session  # noqa: E402
from wattloom.workbench import catalog, store_checks  # noqa: E402

HEADLINE = (
    "hourly_resample",
    "hourly_grid_fill",
    "rolling_outliers",
    "dropouts",
    "quality_gate_batches",
    "readings_upsert",
    "rule_engine",
    "rolling_baseline",
    "volume_baseline",
    "feature_set",
    "seasonal_residuals",
    "trend_statistics",
    "chronological_split",
    "exact_percentile_volume",
    "scenario_outcomes",
    "portfolio_rollup",
    "false_positive_rates",
    "feedback_status",
    "calibration_sets",
    "promotion_gate",
    "building_erasure",
    "analysis_starts",
    "forest_training",
    "window_model_training",
    "forest_scores",
    "window_model_scores",
    "ensemble_findings",
    "stream_meter_ingest",
    "champion_scores",
    "stored_erasure",
    "durable_starts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, shared=tempfile.mkdtemp(prefix="wattloom-bench-"))
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the session's first job outside the clock
    if "champion_scores" in names:
        store_checks.prepared(spark, sf_dir)  # scoring by stored models is timed without their training
    took = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
