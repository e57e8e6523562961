"""Time the headline queries: prints one JSON line with seconds per query.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEATS (timed runs after one warm-up; the median
counts), BENCH_QUERIES (comma list of names, or ``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from auditlake.plans import registry  # noqa: E402
from auditlake.session import build_session  # noqa: E402

HEADLINE = (
    "prediction_by_threshold", "site_confusion_metrics", "manual_site_metrics", "kappa_agreement", "mcnemar_exact",
    "contingency_table", "disagreement_cases", "top_finding", "turnaround_times", "time_stats_quantiles",
    "price_quantiles", "time_summary", "box_plot_stats", "weekly_site_metrics", "weekly_balanced_accuracy",
    "control_band_status", "quick_counts", "clean_report_text", "typed_scores", "first_row_dedupe", "merge_exports",
    "parse_model_json", "study_search", "document_search", "filtered_page", "filter_options", "stratified_sample",
    "encode_findings", "priority_scores", "semi_algorithmic_grade", "nearest_term", "insert_if_absent",
    "upsert_non_null", "apply_manual_labels", "edit_rows", "streaming_weekly_metrics", "full_report_sections",
    "upload_to_store",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    registry.load()
    spark = build_session(
        f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(registry.QUERIES) if only == ["all"] else only or list(HEADLINE)
    run(registry.QUERIES[names[0]], spark, sf_dir)
    seconds: dict[str, float] = {}
    for name in names:
        warm_up = run(registry.QUERIES[name], spark, sf_dir)
        times = [run(registry.QUERIES[name], spark, sf_dir)]
        # A slow query is timed once; the median of several is for those where noise matters.
        while len(times) < repeats and warm_up < 2:
            times.append(run(registry.QUERIES[name], spark, sf_dir))
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
