"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query runs to completion into Spark's ``noop`` sink (full execution, no
collect to the driver). ``BENCH_QUERIES`` (comma list) or ``all`` overrides
the headline set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkstats.plans.catalog import load_all  # noqa: E402
from sparkstats.session import local_session  # noqa: E402

HEADLINE = [
    "geo_top_airports", "delay_by_carrier", "route_stats", "carrier_summary",
    "derive_flights", "subset_sizes", "airport_summary_pct", "value_labels",
    "describe_numeric", "winsorize_flights", "load_clean", "corr_matrix",
    "anova_carrier", "histogram_dep_delay", "auc_dep_delay", "roc_dep_delay",
    "classification_report_priority", "lda_coefficients", "ols_carrier_effects",
    "kmeans_tiers", "durbin_watson", "shapiro_wilk_dep_delay",
    "stratified_split", "label_encode_airports", "box_stats_carrier", "logistic_balanced_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8),
                          app="sparkstats-bench")
    reg = load_all()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = (sorted(reg) if chosen == "all" else
             [n for n in (chosen.split(",") if chosen else HEADLINE) if n in reg])
    times = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_time_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
