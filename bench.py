"""Time the headline queries on one data folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.catalog import registry, tables  # noqa: E402
from cohortlens.session import build_session  # noqa: E402

HEADLINE = (
    "a01_cohort_metric_block",
    "d06_scored_cohorts",
    "a12_nearest_rank_low",
    "c02_posterior_assignment",
    "j02_effective_outcomes",
    "q11_all_failures_per_row",
    "q12_duplicate_quarantine",
    "a19_content_fingerprint",
    "d09_alert_roles",
    "r02_root_cause",
    "c10_candidate_sweep",
    "w07_least_intervention",
    "w12_duplicate_claims",
    "g02_policy_decision",
    "a14_batch_summary",
    "g06_transition_audit",
    "p01_column_profile",
    "p18_group_metrics",
    "p20_spike_hours",
    "p22_key_overlap",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "cohortlens-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="cohortlens-bench-"),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    # One untimed run compiles the shared code paths, so the first query is not charged for starting the JVM.
    queries["d06_scored_cohorts"](spark, folder).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in names:
        tables.forget_shared()  # every query pays for its own analysis
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
        print(name, taken[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
