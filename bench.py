"""Time headline queries and print one JSON line.

Each query runs once to warm up and once on the clock; results go to the no-op
sink, so all rows are computed and none reach the driver.
"""

from __future__ import annotations

import json
import os
import time

from tallyscope import bindings, session

HEADLINE = (
    "a1_area_rollup", "a12_account_profile", "st1_benford_test", "st6_seasonal_additive", "st8_expenditure_score", "st10_gini",
    "j1_worker_profiles", "j2_transfers", "j15_best_scenes", "j17_within_distance", "w3_gap_sessions", "w5_forward_window",
    "m3_ghost_workers", "m4_multi_site_days", "m7_suspicious_dates", "d1_shell_accounts", "d2_split_payments", "d3_material_ratio",
    "p11_integrity", "p13_zero_shot_labels", "r5_change_statistics", "r9_morphology_square", "g3_payment_graph", "g8_hub_accounts",
    "k2_composite_risk", "e2_evidence_chain", "x14_paragraph_chunks", "src5_html_rows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = bindings.load()
    tables = bindings.Tables(spark, folder)
    times: dict[str, float] = {}
    for name in HEADLINE:
        for timed in (False, True):
            start = time.perf_counter()
            known[name].run(tables).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
