"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` (comma separated, or ``all``) another choice of queries.
Each query is run in full: the result goes to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "score_rank",
    "batch_kpis",
    "clean_blank_numeric",
    "clean_guard_duplicates",
    "validate_cleaned",
    "constraint_check",
    "header_suggest",
    "compat_report",
    "detect_key",
    "profile_numeric",
    "profile_nunique",
    "rate_overview",
    "boxplot_stats",
    "stratified_split",
    "kfold_stratified",
    "join_manifest",
    "transform_onehot",
    "validate_matrix",
    "classification_report",
    "average_precision",
    "threshold_sweep",
    "calibration_error",
    "psi",
    "drift_report",
    "monitoring_summary",
    "rolling_performance",
    "stream_score_log",
    "shap_global",
    "smotenc",
    "fit_gbt",
    "train_final",
)


def main() -> None:
    from keelson.catalog import load
    from keelson.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    queries = load()[0]
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    # start the JVM, the Parquet reader and the code generator before the clock
    queries["batch_kpis"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
