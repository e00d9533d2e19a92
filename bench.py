"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Each query is run once to warm up the JVM and then
timed, from building the plan to the last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

from funnelwright.plans.catalog import QUERIES
from funnelwright.session import local_session

HEADLINE = [
    "b11_landing_page",
    "q02_session_duplicates",
    "q04_tx_duplicates",
    "q05_revenue_distribution",
    "q07_suspicious_sources",
    "q10_tx_revenue_hits",
    "q11_channel_composition",
    "q12_funnel_by_channel",
    "q14_monotonic_confound",
    "q15_direct_source_vs_channel",
    "q17b_hidden_direct_concentration",
    "q24_top_countries",
    "q27_funnel_by_device_variants",
    "m22_device_gap",
    "m31_variant_gaps",
    "s01_chi_square",
    "s04_bootstrap_v",
    "s07_cv_compare",
    "s10_attribution_shift",
    "s12_bootstrap_spearman",
    "s13b_visits_to_purchase",
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "funnelwright-bench")
    for name in names:
        run(QUERIES[name], spark, folder)
    times = {name: round(run(QUERIES[name], spark, folder), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "session_funnel_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
