"""Times the headline queries on one machine and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores. Each query is run
to completion into the ``noop`` sink, after a few untimed queries that warm the JVM up; building
the plan, including any eager staging it does, is part of its time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a01_liquidity_statistics",
    "a03_strata",
    "a05_contract_summary",
    "a10_fill_economics",
    "a15_symbol_covariates",
    "a16_symbol_sufficient_statistics",
    "a17_r2_by_groups",
    "a20_calibration_table",
    "a23_signal_economics",
    "a30_binned_means",
    "j04_forward_asof",
    "j05_fill_window",
    "j06_lookback_count",
    "m02_path_and_fill_labels",
    "m04_flow_law_dataset",
    "m07_intensity_law_dataset",
    "m13_decay_law",
    "r01_seeded_sample",
    "r02_select_rows",
    "r07_permute_within_symbol",
    "r10_symbol_bootstrap_of_r2",
    "r12_ratio_bootstrap",
    "s06_quote_grid_next",
    "t02_contract_ranking",
    "w07_prior_quantile",
    "w13_causal_windows",
    "x00_feature_matrix",
]

WARM_UP = ["a05_contract_summary", "w13_causal_windows", "a11_fill_distribution", "m07_intensity_law_dataset"]


def main() -> None:
    from tickloom.queries import QUERIES
    from tickloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
