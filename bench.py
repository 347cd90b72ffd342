"""Headline timings: prints one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from heatgrid.plans.registry import QUERIES
from heatgrid.session import clear_scratch, get_session

HEADLINE = (
    "risk_band_shares",
    "hourly_indices_daily",
    "daily_records",
    "qc_report",
    "climatology",
    "stress_index",
    "excess_heat_factor",
    "idw_weights",
    "deduped_deaths",
    "baseline",
    "district_risk",
    "vulnerability_scores",
    "group_quantiles",
    "forecast_features",
    "roc_auc",
    "target_levels",
    "alert_states",
    "subscription_matches",
    "coverage_pairs",
    "fact_sheet_values",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.files.maxPartitionBytes": "16m",
            "spark.sql.files.openCostInBytes": "262144",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    clear_scratch(spark)
    out = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
